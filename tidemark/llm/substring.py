"""Substring dedup by hashing lines and passages inside lines.

Units are whole lines, and passages: a text is cut into pieces at the end of each line, and inside a line
after words where a hash of two neighbouring words says so (every ``piece_words`` words on average). Such cuts
depend on nothing else, so a passage that is repeated inside other lines has the same pieces there.
A passage unit begins with each piece and ends with the first piece by which it has ``min_words`` words.
Units are normalised (lower case, white space as one) and hashed as a whole; over all documents the
earliest occurrence of a digest, by id and then by place, is kept, and all others are removed, their spans
merged. So each span that is removed consists of lines, and of stretches of ``min_words`` words and more, that
stand like this in one earlier place.

A run, some hundred thousand units of neighbouring documents, asks for each of its distinct digests once, so a
line that a third of all documents have is one row from each run. Units go to the task that decides their
document packed by document; what returns are the digests whose earliest occurrence lies in another run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrow import bounded_batches
from tidemark.llm.words import chunks, hash_runs, locate_words, mix
from tidemark.storage import durable

#: Words in a piece on average, fewest words of a passage and of a line.
PIECE_WORDS, MIN_WORDS, MIN_LINE_WORDS = 6, 20, 1
#: Units of a run; one more document may go beyond it.
HOLD = 200_000
#: Id that null ids count as: they rank last.
LAST = np.int64(2**63 - 1)
_LINE = np.uint64(0x4C494E45)

UNIT = np.dtype([("digest", "<u8"), ("start", "<i4"), ("end", "<i4")])
ENTRY = np.dtype([("digest", "<u8"), ("id", "<i8"), ("doc", "<i4"), ("unit", "<i4")])


def pack_units(u: np.ndarray) -> bytes:
    """Field by field, starts as differences and ends as lengths: that compresses."""
    return b"".join((u["digest"].tobytes(), np.diff(u["start"], prepend=np.int32(0)).astype("<i4").tobytes(), (u["end"] - u["start"]).tobytes()))


def unpack_units(raw: bytes) -> np.ndarray:
    n = len(raw) // UNIT.itemsize
    u = np.empty(n, UNIT)
    u["digest"] = np.frombuffer(raw[: 8 * n], "<u8")
    u["start"] = np.cumsum(np.frombuffer(raw[8 * n : 12 * n], "<i4"))
    u["end"] = u["start"] + np.frombuffer(raw[12 * n :], "<i4")
    return u


def units_of(text: pa.Array, piece_words: int = PIECE_WORDS, min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``(units, bounds)``: units of row i are ``units[bounds[i]:bounds[i + 1]]`` by start; places in code points."""
    h, bounds, starts, ends, raw, offsets = locate_words(text)
    if not len(h):
        return np.empty(0, UNIT), np.zeros(len(text) + 1, np.int64)
    line_of = np.cumsum(raw == 10)[starts]
    row_first = np.zeros(len(h) + 1, bool)
    row_first[bounds] = True
    line_first = row_first[:-1].copy()
    line_first[1:] |= line_of[1:] != line_of[:-1]
    previous = np.where(row_first[:-1], np.uint64(0), np.concatenate(([np.uint64(0)], h[:-1])))
    cut_after = mix(mix(previous) ^ h) % np.uint64(piece_words) == 0
    first = line_first.copy()
    first[1:] |= cut_after[:-1]
    a = np.flatnonzero(first)
    b = np.concatenate((a[1:], [len(h)]))
    # A passage ends with the first piece by which it is long enough, if its text has one.
    last = np.searchsorted(b, a + min_words)
    row = np.searchsorted(bounds, a, "right") - 1
    fits = (last < len(b)) & (b[np.minimum(last, len(b) - 1)] <= bounds[row + 1])
    la = np.flatnonzero(line_first)
    lb = np.concatenate((la[1:], [len(h)]))
    long = lb - la >= min_line_words
    la, lb = la[long], lb[long]
    begin, end = np.concatenate((a[fits], la)), np.concatenate((b[last[fits]], lb))
    digest = np.concatenate((hash_runs(h, a[fits], b[last[fits]]), mix(hash_runs(h, la, lb) ^ _LINE)))
    order = np.argsort(begin, kind="stable")
    begin, end, digest = begin[order], end[order], digest[order]
    point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    row = np.searchsorted(bounds, begin, "right") - 1
    out = np.empty(len(begin), UNIT)
    out["digest"] = digest
    # White space up to the next word of the line goes with the unit.
    follows = np.concatenate((~line_first[1:], [False]))
    until = np.where(follows, np.concatenate((starts[1:], starts[-1:])), ends)
    out["start"], out["end"] = point[starts[begin]] - point[offsets[row]], point[until[end - 1]] - point[offsets[row]]
    return out, np.searchsorted(begin, bounds)


def merged(units: np.ndarray) -> list[tuple[int, int]]:
    """Spans of these units (by start); those that overlap or touch are one."""
    if not len(units):
        return []
    far = np.maximum.accumulate(units["end"])
    at = np.flatnonzero(np.concatenate(([True], units["start"][1:] > far[:-1])))
    return list(zip(units["start"][at].tolist(), far[np.concatenate((at[1:], [len(far)])) - 1].tolist(), strict=True))


def _distinct(entries: np.ndarray) -> np.ndarray:
    """The earliest entry of each digest."""
    e = entries[np.lexsort((entries["unit"], entries["doc"], entries["id"], entries["digest"]))]
    return e[np.concatenate(([True], e["digest"][1:] != e["digest"][:-1]))] if len(e) else e


def _entries(parts: list[np.ndarray], ranks: list[int]) -> np.ndarray:
    """Entries of a run from the units and the rank of each of its documents."""
    size = [len(u) for u in parts]
    e = np.empty(sum(size), ENTRY)
    e["digest"] = np.concatenate([u["digest"] for u in parts]) if parts else []
    e["id"], e["doc"] = np.repeat(np.array(ranks, np.int64), size), np.repeat(np.arange(len(size)), size)
    e["unit"] = np.arange(len(e)) - np.repeat(np.cumsum([0, *size[:-1]]) if size else [], size).astype(np.int64)
    return e


SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    piece_words: int = PIECE_WORDS,
    min_words: int = MIN_WORDS,
    min_line_words: int = MIN_LINE_WORDS,
) -> DataFrame:
    """One row for each input row: ``id_col``, ``n_units``, ``spans`` (removed ``start``, ``end`` in code
    points of the original text, in order), ``sources`` (ids of documents whose occurrence is kept).

    Ids are integers. Documents rank by id, nulls last; rows with equal ids, by their order in the
    input. Null and empty texts have no units. The first of equal documents keeps everything that
    no earlier one has. An empty table gives an empty result; other columns are ignored.
    """
    out = _spans(docs, id_col, F.lit(None), text_col, piece_words, min_words, min_line_words)
    return out.select(F.col("id").alias(id_col), "n_units", "spans", "sources")


def _spans(docs: DataFrame, id_col: str, row: Column, text_col: str, piece_words: int, min_words: int, min_line_words: int) -> DataFrame:
    """``id``, ``row``, ``n_units``, ``spans`` and ``sources`` of each row."""
    bounded_batches(docs.sparkSession)
    rank_of = lambda ids: ids.fill_null(int(LAST)).to_numpy(zero_copy_only=False).astype(np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: a document of a run and its units; kind 1: a digest that the run asks for."""
        run, parts, ranks, held = TaskContext.get().partitionId() << 32, [], [], 0

        def asks() -> Iterator[pa.RecordBatch]:
            e = _distinct(_entries(parts, ranks))
            for k in range(0, len(e), 50_000):
                yield _rows(run, 1, e[k : k + 50_000])

        for b in batches:
            for x, y in chunks(b.column("text")):
                part = b.slice(x, y - x)
                units, bounds = units_of(part.column("text"), piece_words, min_words, min_line_words)
                own = [units[p:q] for p, q in zip(bounds[:-1], bounds[1:], strict=True)]
                n, k = y - x, len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([run] * n, pa.int64()), pa.array([0] * n, pa.int32()), part.column("id"), part.column("row"), pa.array(range(k, k + n), pa.int32()), pa.array(map(pack_units, own), pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], NAMES)
                parts += own
                ranks += rank_of(part.column("id")).tolist()
                held += len(units)
                if held > HOLD:
                    yield from asks()
                    run, parts, ranks, held = run + 1, [], [], 0
        yield from asks()

    kind = dict(docs.dtypes)[id_col]
    types = f"run long, kind int, id {kind}, row long, place int, data binary, digest long, rank long"

    def _rows(run: int, what: int, e: np.ndarray) -> pa.RecordBatch:
        n = len(e)
        return pa.RecordBatch.from_arrays([pa.array([run] * n, pa.int64()), pa.array([what] * n, pa.int32()), pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(e["digest"].view(np.int64)), pa.array(e["id"])], NAMES)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    source = docs.select(F.col(id_col).alias("id"), row.cast("long").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seen = durable(source.mapInArrow(cut, types))

    # A digest has a row for each run at most; the earliest run keeps it, the others are told.
    same = Window.partitionBy("digest")
    asked = seen.where("kind = 1").select("run", "digest", "rank")
    first = asked.withColumn("first", F.min(F.struct("rank", "run")).over(same)).where("run != first.run")
    answers = first.select("run", F.lit(-1).alias("kind"), F.lit(None).cast(kind).alias("id"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("binary").alias("data"), "digest", F.col("first.rank").alias("rank"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a run: answers, then documents in their order."""
        now, away, docs_ = None, [], []
        for b in batches:
            runs, kinds = b.column("run").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero((runs[1:] != runs[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for p, q in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if p == q:
                    continue
                if runs[p] != now:
                    yield from decided(away, docs_)
                    now, away, docs_ = runs[p], [], []
                part = b.slice(p, q - p)
                if kinds[p] == -1:
                    away.append((part.column("digest").to_numpy().view(np.uint64), part.column("rank").to_numpy()))
                else:
                    docs_.append(part.select(["id", "row", "data"]))
        yield from decided(away, docs_)

    def decided(away: list, docs_: list) -> Iterator[pa.RecordBatch]:
        if not docs_:
            return
        parts = [unpack_units(x) for b in docs_ for x in b.column("data").to_pylist()]
        e = _entries(parts, np.concatenate([rank_of(b.column("id")) for b in docs_]).tolist())
        d = _distinct(e)
        here = np.searchsorted(d["digest"], e["digest"])
        mine = (d["doc"][here] == e["doc"]) & (d["unit"][here] == e["unit"])
        keeper, other = d["id"][here], np.zeros(len(e), bool)
        if away and len(e):
            known, ids = (np.concatenate(x) for x in zip(*away, strict=True))
            order = np.argsort(known)
            known, ids = known[order], ids[order]
            at = np.minimum(np.searchsorted(known, e["digest"]), len(known) - 1)
            other = known[at] == e["digest"]
            keeper = np.where(other, ids[at], keeper)
        repeated = other | ~mine
        at, spans, sources = 0, [], []
        for u in parts:
            r = repeated[at : at + len(u)]
            spans.append([{"start": s, "end": t} for s, t in merged(u[r])])
            sources.append([int(x) for x in np.unique(keeper[at : at + len(u)][r]) if x != LAST])
            at += len(u)
        k = 0
        for b in docs_:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), pa.array([len(u) for u in parts[k : k + n]], pa.int64()), pa.array(spans[k : k + n], SPAN), pa.array(sources[k : k + n], pa.list_(pa.int64()))], ["id", "row", "n_units", "spans", "sources"])
            k += n

    both = seen.where("kind = 0").unionByName(answers)
    rows = both.repartition("run").sortWithinPartitions("run", "kind", "place").select("run", "kind", "id", "row", "data", "digest", "rank")
    return rows.mapInArrow(finish, f"id {kind}, row long, n_units long, spans array<struct<start:int,end:int>>, sources array<long>")


NAMES = ["run", "kind", "id", "row", "place", "data", "digest", "rank"]


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    piece_words: int = PIECE_WORDS,
    min_words: int = MIN_WORDS,
    min_line_words: int = MIN_LINE_WORDS,
) -> DataFrame:
    """``docs`` with the spans of ``repeated_spans`` cut out of their texts; all rows and columns.

    Rows are numbered as they are written first and cut by that number: ids may be null or shared.
    A null text stays null.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    x = durable(docs.toDF(*own.values()).withColumn("row", F.monotonically_increasing_id()))
    spans = _spans(x, own[id_col], F.col("row"), own[text_col], piece_words, min_words, min_line_words)
    t, s = F.col(own[text_col]), F.col("spans")
    # What stays are the gaps: from the end of one span to the start of the next.
    gaps = F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: F.substring(t, F.when(i == 0, 1).otherwise(F.get(s, i - 1)["end"] + 1), F.when(i == F.size(s), F.length(t)).otherwise(F.get(s, i)["start"]) - F.when(i == 0, 0).otherwise(F.get(s, i - 1)["end"])))
    joined = x.join(spans.where(F.size("spans") > 0).select("row", "spans"), "row", "left")
    cut = F.when(s.isNull() | t.isNull(), t).otherwise(F.array_join(gaps, ""))
    return joined.select(*(cut.alias(a) if c == text_col else F.col(a) for c, a in own.items())).toDF(*docs.columns)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Production: lines of 5 words and more, passages of 20 and more."""
    out = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_line_words=5)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return out.select("doc_id", "n_units", F.size("spans").cast("long").alias("n_spans"), removed.alias("removed_chars"), F.array_join(F.transform("spans", lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",").alias("spans"), "sources")
