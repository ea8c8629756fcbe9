"""Fixtures of edge cases, and the engine end to end."""

import math
import random
import socket
import struct
import threading
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark import Engine, EngineConfig
from tidemark.functions import epoch_micros, write_checksum
from tidemark.operators import index, reads, sizes
from tidemark.plans.compaction import merge, plan_size_tiered
from tidemark.sources import framed, segments, wal
from tidemark.streaming import ingest, socket_source

WRITES = "series_id string, timestamp long, value double, seq long, gen long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *((i, 0) if len(r) == 3 else ())) for i, r in enumerate(rows)], WRITES)


def tuples(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, EngineConfig(data_dir=str(tmp_path / "data"), compaction_min_tables=2, compaction_size_ratio=100))


def test_overwrite_and_order(spark):
    w = frame(spark, [("a", 5, 5.0), ("a", 1, 1.0), ("a", 1, 2.0), ("a", -5, 0.5)])
    assert tuples(reads.snapshot(w)) == [("a", -5, 0.5), ("a", 1, 2.0), ("a", 5, 5.0)]


def test_bounds(spark):
    p = reads.latest(frame(spark, [("a", i, float(i)) for i in range(1, 6)]))
    assert [r[1] for r in tuples(reads.range_scan(p, "a", 2, 4))] == [2, 3, 4]
    assert tuples(reads.range_scan(p, "a", 4, 2)) == [] == tuples(reads.point_get(p, "b", 1)) == tuples(reads.point_get(p, "a", 9))


def test_special_doubles(spark):
    w = frame(spark, [("a", i, v) for i, v in enumerate((math.nan, math.inf, -math.inf, -0.0))])
    got = [r[2] for r in tuples(reads.snapshot(w))]
    assert math.isnan(got[0]) and got[1:3] == [math.inf, -math.inf] and math.copysign(1, got[3]) == -1


def test_utf8_order(spark):
    assert [r[0] for r in tuples(reads.snapshot(frame(spark, [("\U0001f600", 1, 1.0), ("～", 1, 1.0)])))] == ["～", "\U0001f600"]


@pytest.mark.parametrize(("sid", "good"), [("", False), ("x" * 1024, True), ("x" * 1025, False), ("é" * 513, False), (None, False)])
def test_ids(spark, sid, good):
    df = wal.check_writes(frame(spark, [(sid, 1, 1.0)]))
    if good:
        assert df.count() == 1 and df.collect()
    else:
        with pytest.raises(PySparkException):
            df.collect()


def test_sizes(spark):
    w = frame(spark, [("ab", 1, 1.0), ("ab", 1, 2.0)])
    assert tuples(sizes.offheap_size(w)) == [(0, 44)] and tuples(sizes.onheap_size(w)) == [(0, 116)]


def test_level_merge_and_gap(spark):
    levels = [spark.createDataFrame([("a", 1, float(g), g)], "series_id string, timestamp long, value double, gen long") for g in range(3)]
    assert tuples(reads.level_merge(*levels)) == [("a", 1, 2.0)]
    merged = merge(levels[0], levels[2])
    assert tuples(reads.level_merge(merged, levels[1])) == [("a", 1, 2.0)]


def java_hash(sid, ts, value):
    u = struct.unpack(">q", struct.pack(">d", value))[0] if not math.isnan(value) else 0x7FF8000000000000
    h = 0
    units = sid.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = (31 * h + int.from_bytes(units[i : i + 2], "big")) & 0xFFFFFFFF
    fold = lambda x: ((x & (2**64 - 1)) ^ ((x & (2**64 - 1)) >> 32)) & 0xFFFFFFFF
    for x in (fold(ts), fold(u)):
        h = (31 * h + x) & 0xFFFFFFFF
    return h - 2**32 if h >= 2**31 else h


def test_checksums(spark):
    rows = [("click", 473400, 6.55), ("cpu.load", -5, -0.0), ("a", 1099511627776, math.nan), ("", 0, 0.0)]
    want = [-1487703728, -1875600664, 2147060513, 0]
    r = random.Random(1)
    more = [(r.choice(["é🙂", "x", "abc"]), r.randrange(-(2**62), 2**62), v) for v in (5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.5, 0.1, 1 / 3, math.inf, -math.inf, 1.0, 2.0, 4.0, 1e-310, -1e300, 1023.9999999999999, 2.0**-1022, 2.0**52 + 1, 2.0**-30 * (1 + 2.0**-52))]
    more += [("s", i, r.uniform(-1, 1) * 10.0 ** r.randrange(-300, 300)) for i in range(200)]
    df = frame(spark, rows + more)
    got = [x[0] for x in tuples(df.orderBy("seq").select(write_checksum(F.col("series_id"), F.col("timestamp"), F.col("value"))))]
    assert got[:4] == want and got[4:] == [java_hash(*x) for x in more]


def test_corrupt_row_ends_the_prefix(spark):
    log = wal.with_checksum(frame(spark, [("a", i, float(i)) for i in range(10)]))
    log = log.withColumn("checksum", F.when(F.col("seq") == 4, F.col("checksum") + 1).otherwise(F.col("checksum")))
    assert sorted(r.seq for r in wal.replay_prefix(log).collect()) == [0, 1, 2, 3]
    torn = spark.createDataFrame([("", 0, 0.0, 2, 0, 0)], log.schema).unionByName(log.where("seq < 2"))
    assert sorted(r.seq for r in wal.replay_prefix(torn).collect()) == [0, 1]


def test_replay_twice(spark):
    log = wal.with_checksum(frame(spark, [("a", 1, 1.0), ("a", 1, 2.0)]))
    assert tuples(wal.recovered_points(log.unionByName(log))) == tuples(wal.recovered_points(log)) == [("a", 1, 2.0)]


def test_index_edges(spark):
    p = spark.createDataFrame([("m", i, 0.0) for i in range(300)], "series_id string, timestamp long, value double")
    ix = index.sparse_index(p, 128)
    assert [(r.i, r.timestamp, r.off) for r in ix.orderBy("i").collect()] == [(0, 0, 0), (128, 128, 128 * 21), (256, 256, 256 * 21)]
    probes = spark.createDataFrame([("m", -1), ("m", 128), ("m", 130), ("m", 999), ("a", 5), ("z", 5)], "series_id string, timestamp long")
    floor = {r[:2]: r[2] for r in tuples(index.index_floor(ix, probes))}
    end = {r[:2]: r[2] for r in tuples(index.index_end(ix, probes))}
    assert floor == {("m", -1): 0, ("m", 128): 2688, ("m", 130): 2688, ("m", 999): 5376, ("a", 5): 0, ("z", 5): 5376}
    assert end == {("m", -1): 0, ("m", 128): 5376, ("m", 130): 5376, ("m", 999): -1, ("a", 5): 0, ("z", 5): -1}
    with pytest.raises(ValueError):
        index.sparse_index(p, 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 10**6)), max_size=20, unique_by=lambda x: x[0]), st.floats(1, 4))
def test_plan(sizes_, ratio):
    plan = plan_size_tiered(sizes_, 3, ratio)
    flat = [g for group in plan for g in group]
    assert len(flat) == len(set(flat)) and all(len(g) >= 3 for g in plan)


@pytest.mark.parametrize("bad", [{"sparse_index_interval": 0}, {"memtable_max_size_bytes": 0}, {"bloom_fpp": 0.0}, {"bloom_fpp": 1.0}, {"fsync_policy": "x"}, {"compaction_min_tables": 1}, {"compaction_size_ratio": 0.5}])
def test_config(bad):
    with pytest.raises(ValueError):
        EngineConfig(**bad)


def test_config_paths():
    c = EngineConfig(data_dir="d")
    assert (c.wal_dir, c.segments_dir) == ("d/wal", "d/segments")


def test_epoch_is_zone_free(spark):
    df = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.5' as t union all select timestamp_ntz'1969-12-31 23:59:59' as t")
    assert sorted(r[0] for r in df.select(epoch_micros(F.col("t"))).collect()) == [-1_000_000, 1710037800500000]


def test_segment_round_trip_and_pruning(spark, tmp_path):
    p = spark.range(5000).select(F.concat(F.lit("s"), F.col("id") % 7).alias("series_id"), F.col("id").alias("timestamp"), F.rand(1).alias("value"))
    p = spark.createDataFrame(p.collect(), "series_id string, timestamp long, value double")
    path = str(tmp_path / "seg")
    segments.write_segment(p, path)
    back = segments.open_segment(spark, path)
    assert back.exceptAll(p).isEmpty() and p.exceptAll(back).isEmpty()
    plan = reads.range_scan(back, "s3", 10, 90)._jdf.queryExecution().toString()
    assert "EqualTo(series_id,s3)" in plan and "GreaterThanOrEqual(timestamp,10)" in plan
    with pytest.raises(ValueError, match="nothing to flush"):
        segments.write_segment(p.limit(0), str(tmp_path / "none"))


def put(spark, engine, rows):
    engine.put(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "series_id string, timestamp long, value double, seq long"))


def test_engine_life(spark, engine):
    put(spark, engine, [("a", 1, 1.0), ("b", 1, 1.0)])
    put(spark, engine, [("a", 1, 2.0), ("a", 2, 2.5)])
    assert tuples(engine.get("a", 1)) == [("a", 1, 2.0)]
    engine.flush()
    put(spark, engine, [("a", 1, 3.0), ("c", 7, 7.0)])
    want = [("a", 1, 3.0), ("a", 2, 2.5), ("b", 1, 1.0), ("c", 7, 7.0)]
    assert tuples(engine.snapshot()) == want
    engine.flush()
    assert tuples(engine.scan("a", 1, 2)) == want[:2]
    assert engine.compact() and engine.compact() == []
    assert segments.manifest(spark, engine.config.manifest_dir).count() == 1
    again = Engine(spark, engine.config)
    put(spark, again, [("b", 1, 9.0)])
    assert tuples(again.recover()) == [*want[:2], ("b", 1, 9.0), want[3]]
    again.freeze()
    with pytest.raises(RuntimeError):
        put(spark, again, [("x", 1, 1.0)])
    assert tuples(again.get("b", 1)) == [("b", 1, 9.0)]


def test_empty_flush(engine):
    with pytest.raises(ValueError, match="nothing to flush"):
        engine.flush()


def test_empty_put(spark, engine):
    engine.put(spark.createDataFrame([], "series_id string, timestamp long, value double, seq long"))
    assert engine.snapshot().isEmpty() and engine.pending_bytes() == 0
    with pytest.raises(ValueError, match="nothing to flush"):
        engine.flush()
    put(spark, engine, [("a", 1, 1.0)])
    assert engine.flush() == 1 and tuples(engine.snapshot()) == [("a", 1, 1.0)]


def test_flush_when_full(spark, tmp_path):
    e = Engine(spark, EngineConfig(data_dir=str(tmp_path), memtable_max_size_bytes=60))
    put(spark, e, [("a", i, 1.0) for i in range(2)])
    assert segments.manifest(spark, e.config.manifest_dir).count() == 0
    put(spark, e, [("a", 9, 1.0)])
    assert segments.manifest(spark, e.config.manifest_dir).count() == 1


def test_flush_after_a_put_that_flushed(spark, tmp_path):
    e = Engine(spark, EngineConfig(data_dir=str(tmp_path), memtable_max_size_bytes=60))
    put(spark, e, [("a", i, 1.0) for i in range(3)])
    assert e.flush() == 0 == e.flush()
    e.put(spark.createDataFrame([], "series_id string, timestamp long, value double, seq long"))
    assert e.flush() == 0 and segments.manifest(spark, e.config.manifest_dir).count() == 1
    put(spark, e, [("a", 0, 2.0)])
    assert e.flush() == 2 and tuples(e.snapshot()) == [("a", 0, 2.0), ("a", 1, 1.0), ("a", 2, 1.0)]


def test_appends_after_corruption_are_replayed(spark, engine):
    put(spark, engine, [("a", i, float(i)) for i in range(3)])
    path = f"{engine.config.wal_dir}/log_gen=0"
    log = spark.createDataFrame(spark.read.parquet(path).collect(), spark.read.parquet(path).schema)
    log.withColumn("checksum", F.when(F.col("seq") == 1, F.lit(7)).otherwise(F.col("checksum"))).write.mode("overwrite").parquet(path)
    put(spark, engine, [("a", 9, 9.0)])
    assert [r[1] for r in tuples(engine.snapshot())] == [0, 9]


def test_stream_ingest(spark, engine, tmp_path):
    source = tmp_path / "in"
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], "series_id string, timestamp long, value double")
    df.write.parquet(str(source))
    for _ in range(2):  # the second query has nothing new
        q = ingest(spark.readStream.schema(df.schema).parquet(str(source)), engine, str(tmp_path / "check"))
        q.awaitTermination(60)
    assert tuples(engine.snapshot()) == [("a", 1, 1.0), ("a", 2, 2.0)]


def stream_of(spark, path, rows):
    spark.createDataFrame(rows, "series_id string, timestamp long, value double").coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema("series_id string, timestamp long, value double").parquet(str(path))


def run(q):
    q.awaitTermination(60)


def test_put_then_ingest_with_a_new_checkpoint(spark, engine, tmp_path):
    put(spark, engine, [("a", 1, 1.0), ("p", 1, 1.0)])
    run(ingest(stream_of(spark, tmp_path / "in", [("a", 1, 2.0), ("s", 1, 1.0)]), engine, str(tmp_path / "c1")))
    put(spark, engine, [("p", 1, 3.0)])
    run(ingest(stream_of(spark, tmp_path / "in2", [("s", 1, 4.0)]), engine, str(tmp_path / "c2")))
    assert tuples(engine.snapshot()) == [("a", 1, 2.0), ("p", 1, 3.0), ("s", 1, 4.0)]


def test_flush_then_ingest(spark, engine, tmp_path):
    put(spark, engine, [("a", 1, 1.0)])
    engine.flush()
    stream = stream_of(spark, tmp_path / "in", [("a", 1, 2.0)])
    run(ingest(stream, engine, str(tmp_path / "c")))
    assert tuples(engine.snapshot()) == [("a", 1, 2.0)]
    engine.flush()
    stream_of(spark, tmp_path / "in", [("a", 1, 3.0)])
    run(ingest(stream, engine, str(tmp_path / "c")))
    assert tuples(engine.snapshot()) == [("a", 1, 3.0)]


def batch(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "series_id string, timestamp long, value double, seq long")


def test_replayed_batches(spark, engine):
    """Committed: skipped, also after a flush. Not committed: written anew, above a flush that overtook it."""
    engine.log_batch(batch(spark, ("a", 1, 1.0)), "q.0")
    put(spark, engine, [("a", 1, 2.0)])
    engine.log_batch(batch(spark, ("a", 1, 1.0)), "q.0")
    assert tuples(engine.snapshot()) == [("a", 1, 2.0)]
    engine.flush()
    engine.log_batch(batch(spark, ("a", 1, 1.0)), "q.0")
    assert tuples(engine.snapshot()) == [("a", 1, 2.0)]
    g = engine.log.fresh(engine._flushed())
    engine.log.intend(g, "q.1")  # the crash: a number is given, files may be there, no commit
    batch(spark, ("a", 9, 9.0)).withColumn("gen", F.lit(g)).withColumn("checksum", F.lit(0)).write.parquet(f"{engine.config.wal_dir}/log_gen={g}")
    put(spark, engine, [("b", 1, 5.0)])
    assert tuples(engine.snapshot()) == [("a", 1, 2.0), ("b", 1, 5.0)]
    engine.flush()
    engine.log_batch(batch(spark, ("c", 1, 7.0)), "q.1")
    assert tuples(engine.snapshot()) == [("a", 1, 2.0), ("b", 1, 5.0), ("c", 1, 7.0)]


def test_fsync_policies(spark, tmp_path):
    e = Engine(spark, EngineConfig(data_dir=str(tmp_path / "b"), fsync_policy="BATCH", batch_fsync_size=3))
    for k in range(4):
        put(spark, e, [("a", 1, float(k)), ("k", k, 0.0)])
    assert len(e.log.committed()) == 3 and len(e.unsynced) == 1
    assert tuples(e.get("a", 1)) == [("a", 1, 3.0)]
    assert tuples(Engine(spark, e.config).get("a", 1)) == [("a", 1, 2.0)]
    e.close()
    assert tuples(Engine(spark, e.config).get("a", 1)) == [("a", 1, 3.0)]
    for call in (lambda: put(spark, e, [("a", 1, 1.0)]), e.snapshot, e.flush, e.compact):
        with pytest.raises(RuntimeError, match="closed"):
            call()
    n = Engine(spark, EngineConfig(data_dir=str(tmp_path / "n"), fsync_policy="NONE"))
    put(spark, n, [("a", 1, 1.0)])
    assert n.log.committed() == [] and n.flush() == 0 and tuples(n.snapshot()) == [("a", 1, 1.0)]


def test_sizes_are_kept_with_the_generations(spark, engine):
    put(spark, engine, [("ab", 1, 1.0), ("ab", 1, 2.0)])
    put(spark, engine, [("é", 1, 1.0)])
    assert [g.size_bytes for g in engine.log.committed()] == [44, 22] and engine.pending_bytes() == 66


def test_a_thousand_generations_are_one_scan(spark, engine):
    rows = wal.with_checksum(spark.range(1000).select(F.lit("a").alias("series_id"), (F.col("id") % 10).alias("timestamp"), F.col("id").cast("double").alias("value"), F.col("id").alias("seq"), F.col("id").alias("gen")))
    rows.withColumn("log_gen", F.col("gen")).repartition(1).write.partitionBy("log_gen").parquet(engine.config.wal_dir)
    for g in range(1000):
        engine.log.commit(g, 21)
    assert engine.pending_bytes() == 21_000
    plan = engine.pending()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 2
    assert tuples(engine.snapshot()) == [("a", i, 990.0 + i) for i in range(10)]


def test_compaction_beside_reads_and_writes(spark, engine):
    for k in range(3):
        put(spark, engine, [("a", 1, float(k)), ("k", k, 0.0)])
        engine.flush()
    work = engine.compact_async()
    put(spark, engine, [("a", 1, 9.0)])
    assert tuples(engine.get("a", 1)) == [("a", 1, 9.0)]
    assert work.result() == [2]
    assert tuples(engine.snapshot()) == [("a", 1, 9.0), *(("k", k, 0.0) for k in range(3))]


def test_entries(spark, tmp_path):
    rows = [("é", -7, -0.0), ("a", 1, 1.5), ("a", -1, math.inf)]
    got = framed.encode_entries(spark.createDataFrame(rows, "series_id string, timestamp long, value double")).orderBy("part", "batch").collect()
    data = b"".join(bytes(r.entries) for r in got)
    assert data == b"".join(struct.pack(f">i{len(s.encode())}sqd", len(s.encode()), s.encode(), t, v) for s, t, v in sorted(rows))
    tail = {"whole": data, "torn": data[:-3], "negative": data + struct.pack(">i", -1), "zero": data + struct.pack(">i", 0) + b"\0" * 16, "long": data + struct.pack(">i", 2000) + b"x" * 2016}
    for name, raw in tail.items():
        (tmp_path / name).write_bytes(raw)
    found = {}
    for r in framed.read_entries(spark, str(tmp_path)).orderBy("pos").collect():
        found.setdefault(r.path.rsplit("/", 1)[1], []).append((r.off, r.series_id, r.timestamp, r.value))
    want = [(off, *r) for off, r in zip((0, 21, 42), sorted(rows), strict=True)]
    assert found == {k: want[:2] if k == "torn" else want for k in tail}


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80))
def test_entries_never_crash(data):
    assert all(1 <= len(s.encode()) <= 1024 for _, _, s, *_ in framed.parse_entries(data))


def test_saved_filter_and_index(spark, tmp_path):
    from tidemark.operators import build_bloom, load_bloom, might_contain, save_bloom

    ids = spark.range(300).select(F.concat(F.lit("s"), F.col("id")).alias("series_id"))
    save_bloom(build_bloom(ids, 300, 0.02), str(tmp_path / "bloom"), 300, 0.02)
    b, expected, fpp = load_bloom(spark, str(tmp_path / "bloom"))
    assert (expected, fpp) == (300, 0.02) and might_contain(b, ids, expected, fpp).where("not might_contain").isEmpty()
    p = spark.createDataFrame([("m", i, 0.0) for i in range(300)], "series_id string, timestamp long, value double")
    ix = index.sparse_index(p, 128)
    index.save_index(ix, str(tmp_path / "index"))
    assert sorted(tuples(index.load_index(spark, str(tmp_path / "index")))) == sorted(tuples(ix))


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from tidemark.storage import shared_dir

    conf = SimpleNamespace(get=lambda *a: None, set=lambda *a: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn")))


def test_socket_ingest(spark, engine, tmp_path):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        conn, _ = server.accept()
        conn.sendall(b"a,1,1.5\nbad line\nb,2,x\nb,2,2.5\n")
        time.sleep(20)
        conn.close()

    threading.Thread(target=serve, daemon=True).start()
    q = ingest(socket_source(spark, "127.0.0.1", server.getsockname()[1]), engine, str(tmp_path / "check"), processingTime="1 second")
    try:
        for _ in range(40):
            time.sleep(0.5)
            if engine.log.committed() and engine.pending().count() == 2:
                break
    finally:
        q.stop()
        server.close()
    assert tuples(engine.snapshot()) == [("a", 1, 1.5), ("b", 2, 2.5)]


def test_frames(spark, tmp_path):
    rows = [("a", 1, 1.5), ("é", -7, -0.0), ("b", 2, math.inf)]
    data = b"".join(bytes(r.frames) for r in framed.encode_frames(frame(spark, rows).coalesce(1)).collect())
    tail = {"whole": data, "torn": data[:-3], "no_body": data + struct.pack(">i", 28), "negative": data + struct.pack(">i", -1) + b"xxxx", "short": data + struct.pack(">ii", 8, 4) + b"\0" * 4, "zeros": data + struct.pack(">i", 24) + b"\0" * 24}
    for name, raw in tail.items():
        (tmp_path / name).write_bytes(raw)
    got = {}
    for r in framed.read_frames(spark, str(tmp_path)).orderBy("pos").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.series_id, r.timestamp, r.value))
    assert got == {k: rows[:2] if k == "torn" else rows for k in tail}
    (tmp_path / "whole").write_bytes(data[:-1] + bytes([data[-1] ^ 1]))
    assert framed.read_frames(spark, str(tmp_path / "whole")).count() == 2


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80))
def test_frames_never_crash(data):
    assert all(1 <= len(s.encode()) <= 1024 for _, s, *_ in framed.parse_frames(data))


def test_bloom(spark):
    from tidemark.operators import bloom_size, build_bloom, might_contain

    assert bloom_size(10_000, 0.01) == (95_850, 7)
    frame_ = lambda a, b: spark.range(a, b).select(F.concat(F.lit("s"), F.col("id")).alias("series_id"))
    f = build_bloom(frame_(0, 2000), 2000)
    got = {r.series_id: r.might_contain for r in might_contain(f, frame_(0, 6000), 2000).collect()}
    assert all(got[f"s{i}"] for i in range(2000)) and sum(got[f"s{i}"] for i in range(2000, 6000)) < 120
    with pytest.raises(ValueError):
        bloom_size(0, 0.1)


def test_index_lookups_across_partitions(spark):
    r = random.Random(5)
    keys = sorted({(r.choice("bdfh") + str(r.randrange(3)), r.randrange(400)) for _ in range(900)})
    p = spark.createDataFrame([(*k, 0.0) for k in keys], "series_id string, timestamp long, value double").repartition(7)
    ix = index.sparse_index(p, 10)
    offs, at = [], 0
    for i, k in enumerate(keys):
        if i % 10 == 0:
            offs.append((k, at))
        at += 20 + len(k[0])
    probes = sorted({(r.choice("abcdefghi") + str(r.randrange(3)), r.randrange(-5, 410)) for _ in range(300)} | set(keys[::10][:40]))
    df = spark.createDataFrame(probes, "series_id string, timestamp long")
    assert {x[:2]: x[2] for x in tuples(index.index_floor(ix, df))} == {q: max((o for k, o in offs if k <= q), default=0) for q in probes}
    assert {x[:2]: x[2] for x in tuples(index.index_end(ix, df))} == {q: min((o for k, o in offs if k > q), default=-1) for q in probes}
