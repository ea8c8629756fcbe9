"""Sparse index of a sorted segment, and floor and end lookups in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.sizing import entry_bytes
from tidemark.operators.reads import KEY
from tidemark.storage import durable


def with_offsets(points: DataFrame) -> DataFrame:
    """Points with their number ``i`` and byte offset ``off`` in key order.

    A running total over all rows would run in one task. Here each range partition numbers its
    own rows, and the totals of the partitions before it (one row for each partition) are added.
    The partitioned rows are written first: a range partitioning that is computed twice can
    draw different bounds.
    """
    ranged = points.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    ranged = durable(ranged.select(*points.columns, F.spark_partition_id().alias("part")))
    inside = Window.partitionBy("part").orderBy(*KEY)
    size = entry_bytes(F.col("series_id"))
    rows = ranged.select("*", (F.row_number().over(inside) - 1).cast("bigint").alias("_i"), (F.sum(size).over(inside) - size).alias("_off"))
    totals = ranged.groupBy("part").agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    # One row for each shuffle partition: bounded by spark.sql.shuffle.partitions.
    return rows.join(F.broadcast(starts), "part").select(*points.columns, (F.col("_i") + F.col("n0")).alias("i"), (F.col("_off") + F.col("b0")).alias("off"))


def sparse_index(points: DataFrame, interval: int = 128) -> DataFrame:
    """Every ``interval``-th entry in key order, from the first: ``i``, key and byte offset."""
    if interval <= 0:
        raise ValueError("interval must be positive")
    return with_offsets(points).where(F.col("i") % interval == 0).select("i", *KEY, "off")


def _lookup(index: DataFrame, probes: DataFrame, order: list, last, default: int) -> DataFrame:
    """For each probe the offset of the index entry before it in ``order``, else ``default``.

    Index and probes are sorted together in range partitions, so neither a long series nor many
    series land in one task. An entry in an earlier partition is found from one row for each
    partition: ``last`` (max or min) of the offsets before, as offsets rise with the keys.
    """
    rows = index.select(*KEY, "off", F.lit(0).alias("probe")).unionByName(probes.select(*KEY, F.lit(None).cast("bigint").alias("off"), F.lit(1).alias("probe")).distinct())
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = durable(ranged.select("*", F.spark_partition_id().alias("part")))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranged.groupBy("part").agg(last("off").alias("edge")).select("part", last("edge").over(before).alias("edge"))
    near = ranged.select(*KEY, "probe", "part", F.last("off", ignorenulls=True).over(inside).alias("near")).where("probe = 1")
    # One row for each shuffle partition.
    return near.join(F.broadcast(carried), "part").select(*KEY, F.coalesce("near", "edge", F.lit(default)).cast("bigint").alias("off"))


def index_floor(index: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe key the offset of the largest index key at or below it, else 0."""
    return _lookup(index, probes, [F.col("series_id"), F.col("timestamp"), F.col("probe")], F.max, 0)


def index_end(index: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe key the offset of the smallest index key above it, else -1."""
    return _lookup(index, probes, [F.col("series_id").desc(), F.col("timestamp").desc(), F.col("probe").desc()], F.min, -1)


def save_index(index: DataFrame, path: str) -> None:
    """Write an index in key order."""
    index.select("i", *KEY, "off").repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """A saved index, for lookups without the points it was made from."""
    return spark.read.schema("i long, series_id string, timestamp long, off long").parquet(path)
