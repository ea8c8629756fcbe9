"""Binary interchange: big-endian log frames and segment entries, read and written in batches.

A log frame is ``[len:4][id length:4][id][timestamp:8][value:8][checksum:4]``; a segment entry
is ``[id length:4][id][timestamp:8][value:8]``. Frames depend on the ones before, so one file
is read by one task; files are read side by side.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.reads import KEY
from tidemark.schema import MAX_ID_BYTES
from tidemark.sources.wal import with_checksum

FRAMES = "path string, pos long, series_id string, timestamp long, value double, checksum int"


def _frame(sid: str, ts: int, value: float, checksum: int) -> bytes:
    raw = sid.encode()
    body = struct.pack(f">i{len(raw)}sqdi", len(raw), raw, ts, value, checksum)
    return struct.pack(">i", len(body)) + body


def parse_frames(data: bytes) -> Iterator[tuple[int, str, int, float, int]]:
    """Frames up to the first that is cut or malformed. A torn frame is never a point."""
    at, n, pos = 0, len(data), 0
    while n - at >= 4:
        (size,) = struct.unpack_from(">i", data, at)
        if size < 25 or at + 4 + size > n:
            return
        (length,) = struct.unpack_from(">i", data, at + 4)
        if not 1 <= length <= MAX_ID_BYTES or size != 24 + length:
            return
        raw, ts, value, checksum = struct.unpack_from(f">{length}sqdi", data, at + 8)
        try:
            sid = raw.decode()
        except UnicodeDecodeError:
            return
        yield pos, sid, ts, value, checksum
        at, pos = at + 4 + size, pos + 1


def encode_frames(writes: DataFrame) -> DataFrame:
    """``frames``: bytes of a run of writes, in ``seq`` order inside each partition; a row for each Arrow batch."""
    rows = with_checksum(writes).sortWithinPartitions("seq").select("series_id", "timestamp", "value", "checksum")

    def pack(batches):
        for b in batches:
            yield pd.DataFrame({"frames": [b"".join(map(_frame, b.series_id, b.timestamp, b.value, b.checksum))]})

    return rows.mapInPandas(pack, "frames binary")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of each file at ``path`` before its first bad one, checksums verified."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(batches):
        for b in batches:
            for p, content in zip(b.path, b.content, strict=True):
                if found := list(parse_frames(content)):
                    pos, sid, ts, value, checksum = zip(*found, strict=True)
                    yield pd.DataFrame({"path": p, "pos": pos, "series_id": sid, "timestamp": ts, "value": value, "checksum": checksum})

    rows = with_checksum(files.mapInPandas(unpack, FRAMES).withColumnRenamed("checksum", "_stored"))
    bad = rows.where("checksum != _stored").groupBy("path").agg(F.min("pos").alias("_bad"))
    return rows.join(bad, "path", "left").where("_bad is null or pos < _bad").select("path", "pos", "series_id", "timestamp", "value", "checksum")


ENTRIES = "path string, pos long, off long, series_id string, timestamp long, value double"


def _entry(sid: str, ts: int, value: float) -> bytes:
    raw = sid.encode()
    return struct.pack(f">i{len(raw)}sqd", len(raw), raw, ts, value)


def parse_entries(data: bytes) -> Iterator[tuple[int, int, str, int, float]]:
    """``(pos, offset, id, timestamp, value)`` of the entries up to the first that is cut or malformed."""
    at, pos = 0, 0
    while len(data) - at >= 4:
        (length,) = struct.unpack_from(">i", data, at)
        if not 1 <= length <= MAX_ID_BYTES or at + 20 + length > len(data):
            return
        raw, ts, value = struct.unpack_from(f">{length}sqd", data, at + 4)
        try:
            sid = raw.decode()
        except UnicodeDecodeError:
            return
        yield pos, at, sid, ts, value
        at, pos = at + 20 + length, pos + 1


def encode_entries(points: DataFrame) -> DataFrame:
    """``part``, ``batch`` and ``entries``: bytes of a run of points in key order; parts follow each other in key order."""
    rows = points.repartitionByRange(*KEY).sortWithinPartitions(*KEY).select(F.spark_partition_id().alias("part"), *KEY, "value")

    def pack(batches):
        for k, b in enumerate(batches):
            yield pd.DataFrame({"part": [int(b.part.iloc[0])], "batch": [k], "entries": [b"".join(map(_entry, b.series_id, b.timestamp, b.value))]})

    return rows.mapInPandas(pack, "part int, batch int, entries binary")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of each file at ``path`` with their byte offsets, before the first bad one."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(batches):
        for b in batches:
            for p, content in zip(b.path, b.content, strict=True):
                if found := list(parse_entries(content)):
                    pos, off, sid, ts, value = zip(*found, strict=True)
                    yield pd.DataFrame({"path": p, "pos": pos, "off": off, "series_id": sid, "timestamp": ts, "value": value})

    return files.mapInPandas(unpack, ENTRIES)
