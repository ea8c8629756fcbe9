"""Ingest with Structured Streaming."""

from tidemark.streaming.ingest import ingest, socket_source

__all__ = ["ingest", "socket_source"]
