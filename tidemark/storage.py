"""Tables that outlive executors: written once in the shared folder, then read from there."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: set[str] = set()


def _one_machine(spark: SparkSession) -> bool:
    """Whether the driver is the only executor."""
    return bool(re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, on one machine only, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not _one_machine(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    It cuts the lineage, as checkpoint() does, but stays columnar and compressed. ``release``
    deletes the files once nothing reads them; ``clean`` deletes those of all finished queries.
    """
    path = f"{shared_dir(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    _written.add(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def touch(spark: SparkSession, path: str) -> bool:
    """Create an empty file; false if it is there already."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; none if there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through the Hadoop file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def release(df: DataFrame | None) -> None:
    """Delete what ``durable`` wrote for ``df``."""
    if path := getattr(df, "_durable_path", None):
        delete(df.sparkSession, path)
        _written.discard(path)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and broadcasts of plans that are over, and executors return memory.

    The former happens once the driver's JVM collects their handles, which by itself may not happen before a query
    ends: each step's shuffles would then lie on disk beside those of all before it. An executor's heap fills
    before it is collected and keeps that size, beside Python workers that need the memory; a full collection gives
    back what isn't used. A task for each core, all at once, reaches every executor that is idle.
    """
    gc.collect()
    spark._jvm.System.gc()
    if not _one_machine(spark):
        cores = spark.sparkContext.defaultParallelism
        spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


def clean(spark: SparkSession) -> None:
    """Delete all tables that ``durable`` wrote in this process. Results that haven't been read yet are lost."""
    while _written:
        delete(spark, _written.pop())
