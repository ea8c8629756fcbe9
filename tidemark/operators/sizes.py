"""Size estimates of a table of writes, for each generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.sizing import entry_bytes

#: Fixed values of the estimate: bytes of a new series, of each character of its id, of a new key.
SERIES_BYTES, CHAR_BYTES, KEY_BYTES = 64, 2, 48


def offheap_size(writes: DataFrame) -> DataFrame:
    """Bytes appended for each ``gen``: every write counts, overwrites too."""
    return writes.groupBy("gen").agg(F.sum(entry_bytes(F.col("series_id"))).alias("size_bytes"))


def onheap_size(writes: DataFrame) -> DataFrame:
    """Estimate for each ``gen``: new series and new keys count, overwrites don't.

    Two aggregates, keys then series, instead of two distincts in one: the second works on
    what the first has reduced.
    """
    keys = writes.groupBy("gen", "series_id", "timestamp").agg(F.lit(1).alias("one"))
    series = keys.groupBy("gen", "series_id").agg(F.count("*").alias("n_keys"))
    chars = F.length(F.hex(F.encode("series_id", "UTF-16BE"))) / 4
    size = F.lit(SERIES_BYTES) + CHAR_BYTES * chars.cast("bigint") + KEY_BYTES * F.col("n_keys")
    return series.groupBy("gen").agg(F.sum(size).cast("bigint").alias("size_bytes"))


def is_full(sizes: DataFrame, max_bytes: int) -> DataFrame:
    """Whether each generation has reached its limit."""
    return sizes.withColumn("is_full", F.col("size_bytes") >= max_bytes)
