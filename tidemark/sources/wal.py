"""The write log: checksummed rows in arrival order, replayed up to the first bad one.

A generation is a folder of Parquet files, which appear whole when their job commits: this log's fsync.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.hashing import write_checksum
from tidemark.functions.sizing import entry_bytes, valid_id
from tidemark.operators.reads import latest
from tidemark.schema import WRITE
from tidemark.storage import delete, exists, names, touch


def with_checksum(writes: DataFrame) -> DataFrame:
    return writes.withColumn("checksum", write_checksum(F.col("series_id"), F.col("timestamp"), F.col("value")))


def is_sound(prefix: str = "") -> Column:
    """True where id and checksum are right; false for nulls and torn rows."""
    sid, ts, v, c = (F.col(prefix + x) for x in ("series_id", "timestamp", "value", "checksum"))
    whole = sid.isNotNull() & ts.isNotNull() & v.isNotNull() & c.isNotNull()
    return F.coalesce(whole & valid_id(sid) & (write_checksum(sid, ts, v) == c), F.lit(False))


def check_writes(writes: DataFrame) -> DataFrame:
    """Fail the job on the first write with a null or an id that isn't 1 to 1024 bytes."""
    bad = ~valid_id(F.col("series_id")) | F.col("timestamp").isNull() | F.col("value").isNull()
    message = F.concat(F.lit("write rejected: null, or an id not of 1 to 1024 bytes, at seq "), F.coalesce(F.col("seq").cast("string"), F.lit("null")))
    return writes.withColumn("series_id", F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col("series_id")))


@dataclass(frozen=True)
class Generation:
    """A committed generation of the log; ``source`` names the stream's batch it came from, if any."""

    gen: int
    size_bytes: int
    source: str


class LogIndex:
    """Which generations of the log are committed, and which number a stream's batch was given.

    Both are names of empty files, so that one listing tells all and no generation is read for it. A
    generation is visible once its file in ``_commits`` is there; what a crash left without one is never read.
    """

    def __init__(self, spark: SparkSession, wal_dir: str) -> None:
        self.spark, self.commits, self.intents = spark, f"{wal_dir}/_commits", f"{wal_dir}/_intents"

    def committed(self) -> list[Generation]:
        found = (re.fullmatch(r"gen=(\d+),bytes=(\d+),source=(.*)", x) for x in names(self.spark, self.commits))
        return sorted((Generation(int(m[1]), int(m[2]), m[3]) for m in found if m), key=lambda g: g.gen)

    def intended(self) -> dict[str, int]:
        """The newest number that each batch was given."""
        found = sorted((int(m[1]), m[2]) for x in names(self.spark, self.intents) if (m := re.fullmatch(r"gen=(\d+),source=(.*)", x)))
        return {source: gen for gen, source in found}

    def fresh(self, flushed: int) -> int:
        """A number above everything that was ever given, committed or flushed."""
        return max([g.gen for g in self.committed()] + [*self.intended().values(), flushed], default=-1) + 1

    def intend(self, gen: int, source: str) -> None:
        touch(self.spark, f"{self.intents}/gen={gen},source={source}")

    def commit(self, gen: int, size_bytes: int, source: str = "") -> None:
        if not touch(self.spark, f"{self.commits}/gen={gen},bytes={size_bytes},source={source}"):
            raise RuntimeError(f"generation {gen} is committed already: an engine has one writer")


def append(spark: SparkSession, batches: dict[int, DataFrame], wal_dir: str, source: str = "") -> None:
    """Write checked batches (point, ``seq``), each as a generation of the log, in one job; then commit them.

    Bytes are counted while the rows are written. A folder that a crash has left is replaced.
    """
    index, seen, rows = LogIndex(spark, wal_dir), {}, []
    for g, batch in batches.items():
        seen[g] = Observation()
        checked = with_checksum(check_writes(batch.withColumn("gen", F.lit(g).cast("bigint")))).select(*WRITE.fieldNames())
        rows.append(checked.observe(seen[g], F.coalesce(F.sum(entry_bytes(F.col("series_id"))), F.lit(0)).alias("bytes")).withColumn("log_gen", F.lit(g).cast("bigint")))
        delete(spark, f"{wal_dir}/log_gen={g}")
    reduce(DataFrame.unionByName, rows).write.mode("append").partitionBy("log_gen").parquet(wal_dir)
    for g, o in seen.items():
        index.commit(g, o.get["bytes"], source)


def read_log(spark: SparkSession, wal_dir: str, generations: list[int]) -> DataFrame:
    """Rows of these generations, with ``log_gen``: one scan, however many they are."""
    paths = [p for g in generations if exists(spark, p := f"{wal_dir}/log_gen={g}")]
    schema = T.StructType([*WRITE.fields, T.StructField("log_gen", T.LongType())])
    return spark.read.schema(schema).option("basePath", wal_dir).parquet(*paths) if paths else spark.createDataFrame([], schema)


def replay_prefix(log: DataFrame, sound=None, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows before the first bad one in ``seq`` order, of each group of ``by``.

    The first bad ``seq`` is one aggregate with a row for each group that has one, so no sort of the log is
    needed. With no groups it is a single row, joined by broadcast.
    """
    ok = is_sound() if sound is None else sound
    if by:
        bad = log.where(~ok).groupBy(*by).agg(F.min("seq").alias("_first_bad"))
        return log.join(bad, list(by), "left").where("_first_bad is null or seq < _first_bad").drop("_first_bad")
    first_bad = log.where(~ok).agg(F.coalesce(F.min("seq"), F.lit(9223372036854775807)).alias("_first_bad"))
    return log.join(F.broadcast(first_bad), F.col("seq") < F.col("_first_bad")).drop("_first_bad")


def replay(spark: SparkSession, wal_dir: str, generations: list[int]) -> DataFrame:
    """Valid prefix of each log generation. Writes after a bad row go to a new generation."""
    return replay_prefix(read_log(spark, wal_dir, generations), by=("log_gen",)).select(*WRITE.fieldNames())


def recovered_points(log: DataFrame) -> DataFrame:
    """Replay into points. Applying it twice gives the same, as the last write wins."""
    return latest(replay_prefix(log))
