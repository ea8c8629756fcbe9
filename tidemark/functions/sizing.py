"""Sizes of entries, and which ids a write may carry."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import ENTRY_OVERHEAD, MAX_ID_BYTES


def entry_bytes(series_id: Column) -> Column:
    """Bytes of one encoded entry: the UTF-8 id, its length, the timestamp and the value."""
    return F.octet_length(series_id).cast("bigint") + ENTRY_OVERHEAD


def valid_id(series_id: Column) -> Column:
    """True for ids of 1 to 1024 UTF-8 bytes; false for null."""
    return F.coalesce(F.octet_length(series_id).between(1, MAX_ID_BYTES), F.lit(False))
