"""Last write wins, and the reads over it.

``max_by`` keeps one row for each key in a partial aggregate, so a hot series is reduced
before the shuffle, and filters on the key reach the Parquet scan below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("series_id", "timestamp")


def latest(writes: DataFrame, *version: str) -> DataFrame:
    """One row for each key: the value of the highest version, ``seq`` unless others are named.

    Writes with equal versions of one key are a caller's error; one of them stays.
    """
    by: Column = F.struct(*version) if len(version) > 1 else F.col(version[0] if version else "seq")
    return writes.groupBy(*KEY).agg(F.max_by("value", by).alias("value"))


def point_get(points: DataFrame, series_id: str, timestamp: int) -> DataFrame:
    """The point of one key; no row if there is none."""
    return points.where((F.col("series_id") == series_id) & (F.col("timestamp") == timestamp))


def range_scan(points: DataFrame, series_id: str, start: int, end: int) -> DataFrame:
    """Points of one series, both bounds included, ascending. An inverted range is empty."""
    return points.where((F.col("series_id") == series_id) & F.col("timestamp").between(start, end)).orderBy("timestamp")


def snapshot(writes: DataFrame, *version: str) -> DataFrame:
    """All live points in key order."""
    return latest(writes, *version).orderBy(*KEY)


def level_merge(*levels: DataFrame) -> DataFrame:
    """Newest generation wins across levels that are each free of repeated keys (``gen`` column)."""
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return latest(out, "gen")


def might_contain_series(points: DataFrame, probes: DataFrame) -> DataFrame:
    """Probe ids with the exact answer to "has this series any point?"."""
    present = points.select("series_id").distinct().withColumn("present", F.lit(True))
    return probes.join(present, "series_id", "left").select("series_id", F.coalesce("present", F.lit(False)).alias("present"))
