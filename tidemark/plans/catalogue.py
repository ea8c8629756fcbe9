"""The registered queries: each operator over the ``events`` table, and its SQL.

Writes are made from events: ``seq`` is the event's id, ``series_id`` its type, ``timestamp``
the hour since 1970, ``gen`` a number for every 2,500 events.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import EngineConfig
from tidemark.engine import Engine
from tidemark.functions import entry_bytes, timestamp_micros, write_checksum
from tidemark.operators import bloom, index, reads, sizes
from tidemark.plans import compaction
from tidemark.sources import segments, wal
from tidemark.storage import durable, shared_dir
from tidemark.streaming import ingest

HOUR = 3_600_000_000
PROBES = [("click", 473000), ("click", 473400), ("error", 999999), ("aaa", 1), ("zzz", 1), ("view", 473360)]


def writes(spark: SparkSession, sf_dir: str, series: str = "event_type") -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = timestamp_micros(F.col("ts"), HOUR)
    return events.select(F.col("event_id").alias("seq"), F.col(series).cast("string").alias("series_id"), hour.alias("timestamp"), "value", F.floor(F.col("event_id") / 2500).cast("bigint").alias("gen"))


def lineitem_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many series: a part's price by shipping day; the order and line number the writes of a key."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").cast("string").alias("series_id"), timestamp_micros(F.col("l_shipdate"), 24 * HOUR).alias("timestamp"), F.col("l_extendedprice").alias("value"))


def _latest(spark, d):
    return reads.latest(writes(spark, d))


def _levels(spark, d):
    """Last write of each key inside each generation."""
    return writes(spark, d).groupBy("gen", *reads.KEY).agg(F.max_by("value", "seq").alias("value"))


def _probes(spark):
    return spark.createDataFrame(PROBES, "series_id string, timestamp long")


def _log(spark, d):
    """The log with every 997th checksum damaged."""
    log = durable(wal.with_checksum(writes(spark, d)))
    return log.withColumn("checksum", F.when(F.col("seq") % 997 == 996, F.col("checksum").bitwiseXOR(F.lit(1))).otherwise(F.col("checksum")))


def _probe_ids(spark):
    return spark.createDataFrame([(x,) for x in ("click", "view", "error", "aaa", "zzz")], "series_id string")


def _compaction(spark, d):
    """The plan over the manifest (one row for each generation) and the merged rows' totals."""
    rows = segments.metadata(_levels(spark, d), "gen").select("gen", "data_bytes").collect()
    groups = compaction.plan_size_tiered([(r.gen, r.data_bytes) for r in rows], 4, 1e9)
    keep = [g for group in groups for g in group]
    return compaction.merge(_levels(spark, d).where(F.col("gen").isin(keep) if keep else F.lit(False)))


BATCHES = 4


def _batches(spark, d):
    """The writes in four batches of arrival."""
    w = writes(spark, d)
    n = w.count()
    return [w.where(F.floor(F.col("seq") * BATCHES / n) == k).drop("gen") for k in range(BATCHES)]


def _engine(spark, **settings):
    return Engine(spark, EngineConfig(data_dir=f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}", compaction_min_tables=2, compaction_size_ratio=1e9, **settings))


def _flushed_manifest(spark, d):
    """Segments as written and opened again: entry counts from the files."""
    engine = _engine(spark)
    out = []
    for k, batch in enumerate(_batches(spark, d)):
        path = f"{engine.config.segments_dir}/{k}"
        segments.write_segment(reads.latest(batch), path)
        out.append(segments.metadata(segments.open_segment(spark, path)).select(F.lit(k).cast("bigint").alias("gen"), "min_timestamp", "max_timestamp", "entry_count"))
    return reduce(DataFrame.unionByName, out)


def _flush_get(spark, d):
    """Two flushed segments, two logged batches, one get."""
    engine = _engine(spark)
    for k, batch in enumerate(_batches(spark, d)):
        engine.put(batch)
        if k < 2:
            engine.flush()
    return engine.get("click", 473400)


def _compact_scan(spark, d):
    engine = _engine(spark)
    for batch in _batches(spark, d):
        engine.put(batch)
        engine.flush()
    engine.compact_async().result()
    return engine.scan("view", 473400, 473500)


def _recover(spark, d):
    """Another engine on the folder: a segment, a logged batch, two puts made durable by closing."""
    engine = _engine(spark, fsync_policy="BATCH", batch_fsync_size=2)
    b = _batches(spark, d)
    engine.put(b[0])
    engine.flush()
    for x in b[1:]:
        engine.put(x)
    engine.close()
    return Engine(spark, engine.config).recover()


def _ingested(spark, d):
    """A put, a flush, a put, then a stream in two batches and one that comes a second time."""
    engine = _engine(spark)
    b = _batches(spark, d)
    engine.put(b[0])
    engine.flush()
    engine.put(b[1])
    source, check = f"{engine.config.data_dir}/in", f"{engine.config.data_dir}/check"
    for x in b[2:]:
        x.select("series_id", "timestamp", "value", "seq").coalesce(1).write.mode("append").parquet(source)
        ingest(spark.readStream.schema("series_id string, timestamp long, value double, seq long").parquet(source), engine, check).awaitTermination()
    engine.log_batch(b[0].select("series_id", "timestamp", "value", "seq"), engine.log.committed()[-1].source)
    return engine.snapshot()


def _saved_floor(spark, d):
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index.save_index(index.sparse_index(_latest(spark, d), 128), path)
    return index.index_floor(index.load_index(spark, path), _probes(spark))


def _saved_bloom(spark, d):
    path, ids = f"{shared_dir(spark)}/bloom-{uuid.uuid4().hex}", writes(spark, d, "user_id")
    bloom.save_bloom(bloom.build_bloom(ids, 10_000), path, 10_000)
    made, expected, fpp = bloom.load_bloom(spark, path)
    return bloom.might_contain(made, ids, expected, fpp)


def queries() -> dict:
    return {
        "snapshot_lww": lambda s, d: _latest(s, d),
        "snapshot_many_series": lambda s, d: reads.latest(lineitem_writes(s, d)),
        "range_scan_many_series": lambda s, d: reads.range_scan(reads.latest(lineitem_writes(s, d)), "17", 9000, 10000),
        "point_get": lambda s, d: reads.point_get(_latest(s, d), "click", 473400),
        "range_scan": lambda s, d: reads.range_scan(_latest(s, d), "view", 473400, 473500),
        "range_scan_inverted": lambda s, d: reads.range_scan(_latest(s, d), "view", 473500, 473400),
        "full_iterator": lambda s, d: reads.snapshot(writes(s, d)),
        "wal_replay_prefix": lambda s, d: wal.replay_prefix(_log(s, d)).select("seq", "series_id", "timestamp", "value", "gen"),
        "wal_recover": lambda s, d: wal.recovered_points(_log(s, d)),
        "wal_checksum": lambda s, d: writes(s, d).select("seq", write_checksum(F.col("series_id"), F.col("timestamp"), F.floor(F.col("value")).cast("double")).alias("checksum")),
        "offheap_size": lambda s, d: sizes.offheap_size(writes(s, d)),
        "onheap_size": lambda s, d: sizes.onheap_size(writes(s, d)),
        "memtable_full": lambda s, d: sizes.is_full(sizes.offheap_size(writes(s, d)), 60_000),
        "entry_encode_size": lambda s, d: writes(s, d).select("seq", entry_bytes(F.col("series_id")).alias("entry_bytes")),
        "segment_metadata": lambda s, d: segments.metadata(_levels(s, d), "gen"),
        "segment_prune": lambda s, d: segments.prune(segments.metadata(_levels(s, d), "gen"), 473600, 473600).select("gen"),
        "level_merge": lambda s, d: reads.level_merge(_levels(s, d)),
        "compaction_merge": _compaction,
        "sparse_index": lambda s, d: index.sparse_index(_latest(s, d), 128),
        "index_floor": lambda s, d: index.index_floor(index.sparse_index(_latest(s, d), 128), _probes(s)),
        "index_end": lambda s, d: index.index_end(index.sparse_index(_latest(s, d), 128), _probes(s)),
        "bloom_no_false_negatives": lambda s, d: bloom.might_contain(bloom.build_bloom(writes(s, d, "user_id"), 10_000), writes(s, d, "user_id"), 10_000),
        "manifest_from_flush": _flushed_manifest,
        "engine_flush_get": _flush_get,
        "engine_compact_scan": _compact_scan,
        "engine_recover": _recover,
        "engine_ingest": _ingested,
        "index_saved_floor": _saved_floor,
        "bloom_saved": _saved_bloom,
        "series_membership": lambda s, d: reads.might_contain_series(writes(s, d), _probe_ids(s)),
    }


_W = f"with writes as (select event_id as seq, event_type as series_id, epoch_us(ts) // {HOUR} as timestamp, value, event_id // 2500 as gen from events)"
_M = f"with many as (select l_orderkey * 8 + l_linenumber as seq, cast(l_partkey as varchar) as series_id, epoch_us(l_shipdate) // {24 * HOUR} as timestamp, l_extendedprice as value from lineitem)"
_S = _W + ", snap as (select series_id, timestamp, arg_max(value, seq) as value from writes group by 1, 2)"
_L = _W + ", lev as (select gen, series_id, timestamp, arg_max(value, seq) as value from writes group by 1, 2, 3)"
_I = _S + ", n as (select *, row_number() over (order by series_id, timestamp) - 1 as i, cast(sum(20 + strlen(series_id)) over (order by series_id, timestamp) - 20 - strlen(series_id) as bigint) as off from snap), idx as (select * from n where i % 128 = 0)"
_P = _I + ", probes as (select * from (values " + ", ".join(f"('{a}', cast({b} as bigint))" for a, b in PROBES) + ") p(series_id, timestamp))"
_BAD = "(select coalesce(min(seq), 9223372036854775807) from writes where seq % 997 = 996)"


def _sql_checksum() -> str:
    """Only event types (ASCII) and whole values from 0 up to 2^20 occur, so the bits of the double are simple."""
    sid = "list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split(series_id, ''), lambda c: cast(ascii(c) as bigint))), lambda a, c: (a * 31 + c) & 4294967295)"
    e = "cast(floor(log2(v)) as bigint)"
    bits = f"case when v = 0 then 0 else ({e} + 1023) * 4503599627370496 + cast((v / pow(2.0, {e}) - 1) * 4503599627370496.0 as bigint) end"
    return (
        f"{_W}, a as (select seq, {sid} as h, (xor(timestamp, timestamp >> 32) & 4294967295) as t, abs(floor(value)) as v, floor(value) < 0 as neg from writes), "
        f"b as (select seq, h, t, ({bits}) as u, neg from a), "
        "c as (select seq, ((((h * 31 + t) & 4294967295) * 31 + (xor(u & 4294967295, (u >> 32) | case when neg then 2147483648 else 0 end) & 4294967295)) & 4294967295) as x from b) "
        "select seq, cast(case when x > 2147483647 then x - 4294967296 else x end as integer) as checksum from c"
    )


def oracle_sql() -> dict[str, str]:
    point = "select series_id, timestamp, value from snap"
    many = "select series_id, timestamp, arg_max(value, seq) as value from many"
    meta = "select gen, min(timestamp) as min_timestamp, max(timestamp) as max_timestamp, count(*) as entry_count, cast(sum(20 + strlen(series_id)) as bigint) as data_bytes from lev group by gen"
    return {
        "snapshot_lww": f"{_S} {point}",
        "snapshot_many_series": f"{_M} {many} group by 1, 2",
        "range_scan_many_series": f"{_M} {many} where series_id = '17' and timestamp between 9000 and 10000 group by 1, 2",
        "point_get": f"{_S} {point} where series_id = 'click' and timestamp = 473400",
        "range_scan": f"{_S} {point} where series_id = 'view' and timestamp between 473400 and 473500",
        "range_scan_inverted": f"{_S} {point} where series_id = 'view' and timestamp between 473500 and 473400",
        "full_iterator": f"{_S} {point}",
        "wal_replay_prefix": f"{_W} select seq, series_id, timestamp, value, gen from writes where seq < {_BAD}",
        "wal_recover": f"{_W} select series_id, timestamp, arg_max(value, seq) as value from writes where seq < {_BAD} group by 1, 2",
        "wal_checksum": _sql_checksum(),
        "offheap_size": f"{_W} select gen, cast(sum(20 + strlen(series_id)) as bigint) as size_bytes from writes group by gen",
        "onheap_size": f"{_W}, k as (select gen, series_id, count(distinct timestamp) as n from writes group by 1, 2) select gen, cast(sum(64 + 2 * length(series_id) + 48 * n) as bigint) as size_bytes from k group by gen",
        "memtable_full": f"{_W} select gen, cast(sum(20 + strlen(series_id)) as bigint) as size_bytes, sum(20 + strlen(series_id)) >= 60000 as is_full from writes group by gen",
        "entry_encode_size": f"{_W} select seq, cast(20 + strlen(series_id) as bigint) as entry_bytes from writes",
        "segment_metadata": f"{_L} {meta}",
        "segment_prune": f"{_L} select gen from ({meta}) where 473600 between min_timestamp and max_timestamp",
        "level_merge": f"{_L} select series_id, timestamp, arg_max(value, gen) as value from lev group by 1, 2",
        "compaction_merge": f"{_L} select series_id, timestamp, arg_max(value, gen) as value, max(gen) as gen from lev where (select count(distinct gen) from lev) >= 4 group by 1, 2",
        "sparse_index": f"{_I} select cast(i as bigint) as i, series_id, timestamp, off from idx",
        "index_floor": f"{_P} select p.series_id, p.timestamp, cast(coalesce(max(x.off), 0) as bigint) as off from probes p left join idx x on (x.series_id, x.timestamp) <= (p.series_id, p.timestamp) group by 1, 2",
        "index_end": f"{_P} select p.series_id, p.timestamp, cast(coalesce(min(x.off), -1) as bigint) as off from probes p left join idx x on (x.series_id, x.timestamp) > (p.series_id, p.timestamp) group by 1, 2",
        "bloom_no_false_negatives": "select distinct cast(user_id as varchar) as series_id, true as might_contain from events",
        "manifest_from_flush": f"{_W} select (seq * {BATCHES}) // (select count(*) from writes) as gen, min(timestamp) as min_timestamp, max(timestamp) as max_timestamp, count(distinct (series_id, timestamp)) as entry_count from writes group by 1",
        "engine_flush_get": f"{_S} {point} where series_id = 'click' and timestamp = 473400",
        "engine_compact_scan": f"{_S} {point} where series_id = 'view' and timestamp between 473400 and 473500",
        "engine_recover": f"{_S} {point}",
        "engine_ingest": f"{_S} {point}",
        "index_saved_floor": f"{_P} select p.series_id, p.timestamp, cast(coalesce(max(x.off), 0) as bigint) as off from probes p left join idx x on (x.series_id, x.timestamp) <= (p.series_id, p.timestamp) group by 1, 2",
        "bloom_saved": "select distinct cast(user_id as varchar) as series_id, true as might_contain from events",
        "series_membership": f"{_W} select series_id, series_id in (select series_id from writes) as present from (values ('click'), ('view'), ('error'), ('aaa'), ('zzz')) p(series_id)",
    }
