"""tidemark: a Spark-native engine for points ``(series_id, timestamp, value)``."""

from tidemark.config import EngineConfig
from tidemark.engine import Engine

__all__ = ["Engine", "EngineConfig"]
