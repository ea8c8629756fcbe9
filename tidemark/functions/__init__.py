"""Column functions of the engine."""

from tidemark.functions.epoch import epoch_micros, timestamp_micros
from tidemark.functions.hashing import write_checksum
from tidemark.functions.sizing import entry_bytes, valid_id

__all__ = ["entry_bytes", "epoch_micros", "timestamp_micros", "valid_id", "write_checksum"]
