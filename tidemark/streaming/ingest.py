"""Micro-batch ingest: the single writer of an engine.

No watermark: late writes are upserts and must not be dropped. No keyed state either: the last
write is found when points are read or merged. ``foreachBatch`` may run a batch twice. A batch is known
by the query's id and its number; its log generation is a fresh one, above all puts, flushes and batches
before it. One that was committed is skipped when it comes again, one that wasn't is written anew.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def socket_source(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines ``series_id,timestamp,value`` from a TCP socket; lines that don't parse are left out."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    parts = F.split("value", ",")
    rows = lines.select(F.try_element_at(parts, F.lit(1)).alias("series_id"), F.expr("try_cast(try_element_at(split(value, ','), 2) as bigint)").alias("timestamp"), F.expr("try_cast(try_element_at(split(value, ','), 3) as double)").alias("v"))
    return rows.dropna().withColumnRenamed("v", "value")


def ingest(stream: DataFrame, engine, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the query that logs every batch of ``stream`` and flushes when the table is full.

    ``stream`` has ``series_id``, ``timestamp`` and ``value``, and ``seq`` if the source numbers
    its writes; else they are numbered in the order of the batch's partitions.
    """

    ids: list[str] = []

    def batch(df: DataFrame, epoch: int) -> None:
        if not ids:  # Spark writes it before the first batch; a new checkpoint is a new query
            ids.append(json.loads(df.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"])
        if "seq" not in df.columns:
            df = df.withColumn("seq", F.lit(epoch).cast("bigint") * (1 << 40) + F.monotonically_increasing_id() % (1 << 40))
        engine.log_batch(df.select("series_id", "timestamp", "value", "seq"), f"{ids[0]}.{epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
