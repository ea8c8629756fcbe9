"""A Bloom filter over series ids as a DataFrame, built and probed with built-in functions.

Parquet's own bloom filters do the pruning when a segment is read (``sources.segments``); this one is for
asking many ids at once without reading any data. It is a table of 4 KB chunks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits in a chunk, as the bitmap functions have them.
CHUNK_BITS = 32768
#: Fewest bits of a filter.
MIN_BITS = 64


def bloom_size(expected: int, fpp: float) -> tuple[int, int]:
    """Bits and hash functions for ``expected`` insertions at a false-positive rate of ``fpp``."""
    if expected <= 0 or not 0 < fpp < 1:
        raise ValueError("expected must be positive and fpp between 0 and 1")
    bits = max(MIN_BITS, math.floor(-expected * math.log(fpp) / math.log(2) ** 2))
    return bits, max(1, math.floor(bits / expected * math.log(2) + 0.5))


def _slots(series_id: Column, bits: int, hashes: int) -> Column:
    """Places from 1, by double hashing."""
    a, b = F.xxhash64(series_id, F.lit(1)), F.xxhash64(series_id, F.lit(2))
    top = F.lit(2**62)
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (F.pmod(a, top) % bits + i * (F.pmod(b, top) % bits)) % bits + 1)


def build_bloom(points: DataFrame, expected: int, fpp: float = 0.01) -> DataFrame:
    """``chunk`` and ``bitmap`` of the ids in ``points``: at most bits / 32,768 rows."""
    bits, hashes = bloom_size(expected, fpp)
    slots = points.select("series_id").distinct().select(F.explode(_slots(F.col("series_id"), bits, hashes)).alias("slot"))
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))


def might_contain(bloom: DataFrame, probes: DataFrame, expected: int, fpp: float = 0.01) -> DataFrame:
    """``series_id`` and ``might_contain``: never false for an id that was added."""
    bits, hashes = bloom_size(expected, fpp)
    asked = probes.select("series_id").distinct().select("series_id", F.explode(_slots(F.col("series_id"), bits, hashes)).alias("slot"))
    asked = asked.select("series_id", F.bitmap_bucket_number("slot").alias("chunk"), F.bitmap_bit_position("slot").alias("at"))
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(F.col("at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1, F.lit(False))
    return asked.join(bloom, "chunk", "left").groupBy("series_id").agg(F.bool_and(hit).alias("might_contain"))


def save_bloom(bloom: DataFrame, path: str, expected: int, fpp: float = 0.01) -> None:
    """Write a filter with what it was sized for."""
    bloom.select("chunk", "bitmap", F.lit(expected).cast("long").alias("expected"), F.lit(float(fpp)).alias("fpp")).write.parquet(path)


def load_bloom(spark: SparkSession, path: str) -> tuple[DataFrame, int, float]:
    """The filter, ``expected`` and ``fpp``, as ``might_contain`` takes them. ValueError if there is no filter."""
    rows = spark.read.schema("chunk long, bitmap binary, expected long, fpp double").parquet(path)
    size = rows.select("expected", "fpp").first()
    if size is None:
        raise ValueError(f"no filter at {path}")
    return rows.select("chunk", "bitmap"), size.expected, size.fpp
