"""Immutable sorted segments (Parquet, one folder for each generation) and their manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import EngineConfig
from tidemark.functions.sizing import entry_bytes
from tidemark.operators.reads import KEY
from tidemark.schema import MANIFEST, POINT
from tidemark.storage import exists

#: Up to so many distinct series a dictionary prunes row groups; beyond, a bloom filter does.
DICTIONARY_SERIES = 10_000


def write_segment(points: DataFrame, path: str, config: EngineConfig | None = None, series: int | None = None) -> None:
    """Range-partition and sort ``points`` by key and write them with page index and bloom filter.

    ``series`` is the expected number of distinct ids (by default estimated): Parquet drops
    bloom filters of columns that stay dictionary-encoded, so the dictionary is turned off for
    many series. Raises ValueError if there is nothing to write.
    """
    config = config or EngineConfig()
    if series is None:
        series = points.agg(F.approx_count_distinct("series_id")).first()[0]
    if not series:
        raise ValueError("nothing to flush")
    bloom = max(series, config.bloom_expected_insertions)
    (
        points.repartitionByRange(*KEY)
        .sortWithinPartitions(*KEY)
        .write.mode("error")
        .option("parquet.page.row.count.limit", config.sparse_index_interval)
        .option("parquet.bloom.filter.enabled#series_id", "true")
        .option("parquet.bloom.filter.expected.ndv#series_id", bloom)
        .option("parquet.bloom.filter.fpp#series_id", config.bloom_fpp)
        .option("parquet.enable.dictionary#series_id", str(series <= DICTIONARY_SERIES).lower())
        .parquet(path)
    )


def open_segment(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """A segment as a DataFrame; filters on the key are pushed to its row groups and pages.

    ``extra`` names a bigint column that a merged segment carries besides the point.
    """
    return open_segments(spark, [path], extra)


def open_segments(spark: SparkSession, paths: list[str], extra: str = "") -> DataFrame:
    """Several segments in one scan."""
    schema = POINT
    if extra:
        schema = T.StructType([*POINT.fields, T.StructField(extra, T.LongType(), False)])
    return spark.read.schema(schema).parquet(*paths)


def metadata(points: DataFrame, *group: str) -> DataFrame:
    """Smallest and largest timestamp, entries and data bytes of ``points``, for each ``group``."""
    return points.groupBy(*group).agg(
        F.min("timestamp").alias("min_timestamp"),
        F.max("timestamp").alias("max_timestamp"),
        F.count("*").alias("entry_count"),
        F.sum(entry_bytes(F.col("series_id"))).alias("data_bytes"),
    )


def prune(manifest: DataFrame, start: int, end: int) -> DataFrame:
    """Manifest rows of segments that may hold timestamps from ``start`` to ``end``, both included."""
    return manifest.where((F.col("min_timestamp") <= end) & (F.col("max_timestamp") >= start))


def publish(spark: SparkSession, manifest_dir: str, row: tuple) -> None:
    """Append one manifest row. Until this is done the segment isn't visible to any reader."""
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(manifest_dir)


def manifest(spark: SparkSession, manifest_dir: str) -> DataFrame:
    """Live segments: published rows without those that a later merge has replaced.

    A merged row lists the segments it was made from in ``sources``.
    """
    if not exists(spark, manifest_dir):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).parquet(manifest_dir)
    gone = rows.select(F.explode("sources").alias("segment_id")).distinct()
    return rows.join(gone, "segment_id", "left_anti").select(*MANIFEST.fieldNames())
