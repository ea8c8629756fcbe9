"""The facade: put, flush, get, scan, snapshot, compact and recover over one folder."""

from __future__ import annotations

import uuid
from concurrent.futures import Future, ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import EngineConfig
from tidemark.operators import reads
from tidemark.plans.compaction import merge, plan_size_tiered
from tidemark.schema import WRITE
from tidemark.sources import segments, wal


class Engine:
    """An engine over ``config.data_dir``, with one writer.

    Unflushed writes are the committed log generations above the newest flushed one, so a new Engine on
    the same folder sees what the old one had acknowledged.
    """

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None) -> None:
        self.spark, self.config, self.frozen, self.closed = spark, config or EngineConfig(), False, False
        self.log = wal.LogIndex(spark, self.config.wal_dir)
        #: Puts that the fsync policy holds back, by their generation.
        self.unsynced: dict[int, DataFrame] = {}
        self._upkeep = ThreadPoolExecutor(1)

    def _check_open(self) -> None:
        if self.closed:
            raise RuntimeError("the engine is closed")

    def _rows(self) -> list:
        return segments.manifest(self.spark, self.config.manifest_dir).orderBy("gen").collect()

    def _flushed(self) -> int:
        """The newest log generation that is in a segment; merged segments keep the newest of theirs."""
        return max((r.gen for r in self._rows()), default=-1)

    def _pending(self) -> list[wal.Generation]:
        flushed = self._flushed()
        return [g for g in self.log.committed() if g.gen > flushed]

    def pending(self) -> DataFrame:
        """Writes that no segment has yet: the valid prefix of each log generation, and what isn't synced."""
        out = wal.replay(self.spark, self.config.wal_dir, [g.gen for g in self._pending()])
        held = [wal.with_checksum(wal.check_writes(x.withColumn("gen", F.lit(g).cast("bigint")))).select(*WRITE.fieldNames()) for g, x in self.unsynced.items()]
        return reduce(DataFrame.unionByName, held, out)

    # Writes.

    def put(self, writes: DataFrame) -> None:
        """Log a batch of ``(series_id, timestamp, value, seq)`` as a new log generation.

        It is durable when this returns, unless the fsync policy holds it back; readers see it at once.
        """
        self._check_open()
        if self.frozen:
            raise RuntimeError("the engine is frozen")
        self.unsynced[max([self.log.fresh(self._flushed()), *(g + 1 for g in self.unsynced)])] = writes
        policy = self.config.fsync_policy
        if policy == "EVERY_WRITE" or (policy == "BATCH" and len(self.unsynced) >= self.config.batch_fsync_size):
            self.sync()
            self.flush_if_full()

    def sync(self) -> None:
        """Make all puts durable, in one job."""
        self._check_open()
        if self.unsynced:
            held, self.unsynced = self.unsynced, {}
            wal.append(self.spark, held, self.config.wal_dir)

    def log_batch(self, writes: DataFrame, source: str) -> None:
        """Log a batch of a stream, once: ``source`` names the query and the batch."""
        self._check_open()
        if any(g.source == source for g in self.log.committed()):
            return
        self.sync()
        flushed = self._flushed()
        gen = self.log.intended().get(source, -1)
        if gen <= flushed:  # a new batch, or one that puts and a flush have overtaken
            gen = self.log.fresh(flushed)
            self.log.intend(gen, source)
        wal.append(self.spark, {gen: writes}, self.config.wal_dir, source)
        self.flush_if_full()

    def freeze(self) -> None:
        """Refuse later puts; reads go on."""
        self.frozen = True

    def close(self) -> None:
        """Make all puts durable, wait for a running compaction, refuse everything after."""
        if not self.closed:
            self.sync()
            self._upkeep.shutdown()
            self.closed = True

    def pending_bytes(self) -> int:
        """Of the durable ones; counted when they were written."""
        return sum(g.size_bytes for g in self._pending())

    def flush_if_full(self) -> bool:
        """Flush if the pending writes have reached the limit. One batch may go beyond it."""
        full = self.pending_bytes() >= self.config.memtable_max_size_bytes
        if full:
            self.flush()
        return full

    def flush(self) -> int:
        """Write the pending points as a segment, publish it, return its generation.

        A put or a batch that fills the table has flushed by itself; without writes since then nothing is
        written and the newest flushed generation is returned. It is an error only before the first write.
        """
        self.sync()
        pending = self._pending()
        if not any(g.size_bytes for g in pending):
            if (flushed := self._flushed()) < 0:
                raise ValueError("nothing to flush")
            return flushed
        generations = [g.gen for g in pending]
        gen = generations[-1]
        rows = wal.replay(self.spark, self.config.wal_dir, generations)
        points = reads.latest(rows, "gen", "seq").withColumn("gen", F.lit(gen).cast("bigint"))
        self._publish(points, gen, [], rows)
        return gen

    def _publish(self, points: DataFrame, gen: int, sources: list[str], rows: DataFrame) -> None:
        """``rows``: what ``points`` were made from; counting its ids is a scan of one column."""
        name = f"{gen:020d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.config.segments_dir}/{name}"
        series = rows.agg(F.approx_count_distinct("series_id")).first()[0]
        segments.write_segment(points, path, self.config, series)
        m = segments.metadata(segments.open_segment(self.spark, path)).first()
        segments.publish(self.spark, self.config.manifest_dir, (name, gen, path, m.min_timestamp, m.max_timestamp, m.entry_count, m.data_bytes, sources))

    # Reads.

    def _levels(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """All levels that may hold the timestamps, with ``gen`` and ``seq``."""
        self._check_open()
        rows = segments.manifest(self.spark, self.config.manifest_dir)
        if start is not None:
            rows = segments.prune(rows, start, end)
        out = self.pending().select("series_id", "timestamp", "value", "gen", "seq")
        if paths := [r.path for r in rows.collect()]:  # one scan over all of them
            out = out.unionByName(segments.open_segments(self.spark, paths, "gen").withColumn("seq", F.lit(-1).cast("bigint")))
        return out

    def get(self, series_id: str, timestamp: int) -> DataFrame:
        """One row, or none. The key filter reaches the Parquet scans below the merge."""
        return reads.point_get(reads.latest(self._levels(timestamp, timestamp), "gen", "seq"), series_id, timestamp)

    def scan(self, series_id: str, start: int, end: int) -> DataFrame:
        return reads.range_scan(reads.latest(self._levels(start, end), "gen", "seq"), series_id, start, end)

    def snapshot(self) -> DataFrame:
        return reads.snapshot(self._levels(), "gen", "seq")

    # Upkeep.

    def compact(self) -> list[int]:
        """Merge what the planner groups; returns the new generations. Old files stay for readers."""
        self._check_open()
        rows = {r.segment_id: r for r in self._rows()}
        made = []
        for group in plan_size_tiered([(k, r.file_size_bytes) for k, r in rows.items()], self.config.compaction_min_tables, self.config.compaction_size_ratio):
            gen = max(rows[k].gen for k in group)
            levels = segments.open_segments(self.spark, [rows[k].path for k in group], "gen")
            self._publish(merge(levels), gen, group, levels)
            made.append(gen)
        return made

    def compact_async(self) -> Future:
        """``compact`` beside reads and writes: they go on with the old segments until a merged one is published."""
        self._check_open()
        return self._upkeep.submit(self.compact)

    def recover(self) -> DataFrame:
        """Live points after a restart: segments, then the valid prefix of what wasn't flushed."""
        return self.snapshot()

    def empty(self) -> DataFrame:
        """A table without writes."""
        return self.spark.createDataFrame([], WRITE)
