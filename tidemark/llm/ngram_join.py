"""N-gram Jaccard self-join with set-relation skipping; exact.

1. ``shingled``: each document becomes a set of hashed word shingles; equal sets are one set from
   here on. Shingles have one global order: a level by how often the shingle's slot in a fixed-size
   sketch occurs over all documents, then the hash. Common passages come last.
2. ``candidates``: two sets that reach the threshold share a shingle among the first
   ``n - ceil(T n) + 1`` of each. Index lists of these shingles are sorted by size and position
   and cut into blocks; a block pair is skipped when no size and position in it can reach the
   threshold, other pairs are compared by what is left after the shared shingle and by a parity
   bitmap of the set (its bits that differ are a lower bound of the difference). Long lists are
   dealt out by size, then by pairs of blocks. What passes is joined in a forest, whose components, without false
   negatives, are clusters.
3. ``links``: inside a cluster every pair is verified on whole sets. A set's overlaps with all others
   are derived from those of the most similar set before it: only lists of the shingles that
   the two don't share are read. Large clusters are compared block by block.

Only forests and counts leave a task, never all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import SMALL_BATCH_BYTES, bounded_batches, lean
from tidemark.llm.exact_dedup import MAX_CHUNKS, bit
from tidemark.llm.graph import Forest, components, stars
from tidemark.llm.runs import whole_runs
from tidemark.llm.words import chunks, mix, shingle_sets
from tidemark.storage import durable, release, sweep

#: Slots of the frequency sketch, and chunks it travels in.
SLOTS, CHUNKS = 1 << 20, 64
#: Bits of the hash that a shingle keeps beneath its level.
LEVEL_SHIFT = 59
#: Largest parity bitmap, in bits.
MAX_BITS = 1 << 16
#: Entries in a block of an index list.
LIST_BLOCK = 256
#: A list longer than this is dealt out by size, and what of it is compared in one go has about LIST_TASK entries at most.
LIST_ROWS, LIST_TASK = 1_000, 8_192
#: Sets, and shingles, in a block of a cluster.
CLUSTER_SETS, CLUSTER_SHINGLES = 512, 1_000_000
#: Bits of the broadcast filter of sets that are in clusters.
MEMBER_BITS = 1 << 24


def shingle_levels(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """Level of each slot: 0 up to about twice the mean count, then by powers of two. Counts all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            text = b.column(0)
            for x, y in chunks(text):
                sets = list(shingle_sets(text.slice(x, y - x), words))
                total += np.bincount((np.concatenate(sets) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        if total.any():
            yield _chunk_rows(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, "<i8")
        for k, v in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "counts": pa.array([v.astype("<i8").tobytes()], pa.binary())})

    schema = "chunk int, counts binary"
    rows = docs.select(F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(lean("ngram_join", count), schema)
    # Two rounds, so that no task adds up the counts of all others.
    rows = rows.withColumn("salt", F.spark_partition_id() % 64).repartition("chunk", "salt").drop("salt").mapInArrow(add, schema)
    rows = rows.repartition(16, "chunk").mapInArrow(add, schema)
    total = np.zeros(SLOTS, np.int64)
    for r in rows.collect():  # CHUNKS rows, SLOTS numbers
        total[r.chunk * (SLOTS // CHUNKS) : (r.chunk + 1) * (SLOTS // CHUNKS)] = np.frombuffer(r.counts, "<i8")
    high = np.log2(np.maximum(total, 1) / (2 * total.mean() + 8))
    return np.clip(np.floor(high) + 1, 0, 15).astype(np.uint8)


def _chunk_rows(total: np.ndarray) -> pa.RecordBatch:
    parts = total.astype("<i8").reshape(CHUNKS, -1)
    return pa.RecordBatch.from_pydict({"chunk": pa.array(range(CHUNKS), pa.int32()), "counts": pa.array([p.tobytes() for p in parts], pa.binary())})


def ordered(shingles: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set in the global order, as numbers that sort in it."""
    level = levels[(shingles & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64)
    return np.unique((level << np.uint64(LEVEL_SHIFT)) | (shingles & np.uint64((1 << LEVEL_SHIFT) - 1)))


def set_key(tokens: np.ndarray) -> int:
    """64 bits that equal sets share."""
    return int(mix(np.array([mix(tokens).sum() + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def bitmap(tokens: np.ndarray, percent: int) -> bytes:
    """Parity of the tokens in each of a power of two of slots, more for larger sets and lower thresholds.

    Unrelated sets differ in half of the bits, which is over twice what the threshold allows: were it near that, a few
    in a hundred pairs would pass, and on a large corpus join most sets to one cluster.
    """
    want = max(64, len(tokens) * (5 * (100 - percent) / 100))
    size = min(MAX_BITS, 1 << int(np.ceil(np.log2(want))))
    odd = np.bincount((mix(tokens) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold_bits(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) of a smaller size: parities of slots that fall together."""
    while bits.shape[1] > size:
        bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
    return bits


def shingled(docs: DataFrame, id_col: str, row: Column, text_col: str, words: int, percent: int, levels: np.ndarray) -> DataFrame:
    """``id``, ``row``, ``n``, ``set`` (null without words), ``prefix`` and ``bits`` of each document."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in chunks(b.column("text")):
                part = b.slice(x, y - x)
                n, key, prefix, bits = [], [], [], []
                for s in shingle_sets(part.column("text"), words):
                    t = ordered(s, shared.value)
                    n.append(len(t))
                    key.append(set_key(t) if len(t) else None)
                    prefix.append(t[: prefix_length(len(t), percent)].view(np.int64) if len(t) else None)
                    bits.append(bitmap(t, percent) if len(t) else None)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row"), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["id", "row", "n", "set", "prefix", "bits"])

    rows = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(lean("ngram_join", run), f"id {kind}, row long, n long, set long, prefix array<long>, bits binary")


def _close(n1, r1, n2, r2, percent: int):
    """Whether sizes and what remains from the shared shingle on can reach the threshold."""
    return (100 + percent) * np.minimum(r1, r2) >= percent * (n1 + n2)


def _list_rows(percent: int):
    """Task of the first pass over the lists: members of a list that some other member may reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for t, bounds in whole_runs(batches, "token"):
            size = np.diff(bounds)
            sets, n, rest = (t.column(c).to_numpy() for c in ("set", "n", "rest"))
            keep = []
            for a, m in zip(bounds[:-1][size > 1], size[size > 1], strict=True):
                if m > 2 * LIST_BLOCK:
                    keep.append(np.arange(a, a + m))
                    continue
                n_, r_ = n[a : a + m], rest[a : a + m]
                ok = _close(n_[:, None], r_[:, None], n_, r_, percent)
                np.fill_diagonal(ok, False)
                if not ok.any():
                    continue
                sign = sets[a : a + m].tobytes() + np.packbits(ok).tobytes()
                if sign in seen:  # the same members, the same comparisons
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(sign)
                keep.append(a + np.flatnonzero(ok.any(axis=1)))
            if keep:
                yield from t.take(pa.array(np.concatenate(keep))).combine_chunks().to_batches()

    return run


def _forest_of_lists(percent: int):
    """Task of the second pass: compare by bitmaps too, and give a forest of what passes."""

    def compare(n, rest, words, bits, x, y, forest, sets, out) -> None:
        """Entries x against entries y of one list."""
        if (100 + percent) * min(rest[x].max(), rest[y].max()) < percent * (n[x].min() + n[y].min()):
            return  # no pair of these blocks can reach the threshold
        ok = _close(n[x][:, None], rest[x][:, None], n[y], rest[y], percent)
        if len(x) + len(y) > 64:  # what is in one tree already needs no look
            r, s = (np.array([forest.root(k) for k in sets[z].tolist()]) for z in (x, y))
            ok &= r[:, None] != s
        i, j = np.nonzero(ok)
        i, j = x[i], y[j]
        i, j = i[i < j], j[i < j]
        if not len(i):
            return
        least = np.minimum(words[i], words[j])
        for size in np.unique(least):
            at = least == size
            a, b = (_words(bits, k[at], words, size) for k in (i, j))
            apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            good = (100 + percent) * apart <= (100 - percent) * (n[i[at]] + n[j[at]])
            for p, q in zip(sets[i[at][good]].tolist(), sets[j[at][good]].tolist(), strict=True):
                if forest.join(p, q):
                    out.append((p, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for t, bounds in whole_runs(batches, "token"):
            out: list[tuple[int, int]] = []
            sets, n, rest = (t.column(c).to_numpy() for c in ("set", "n", "rest"))
            raw = t.column("bits").to_pylist()
            words = np.array([len(x) // 8 for x in raw])
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                blocks = [np.arange(k, min(k + LIST_BLOCK, b)) for k in range(a, b, LIST_BLOCK)]
                for p, x in enumerate(blocks):
                    for y in blocks[p:]:
                        compare(n, rest, words, raw, x, y, forest, sets, out)
            if out:
                a_, b_ = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], ["a", "b"])

    return run


def _words(bits: list[bytes], rows: np.ndarray, words: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps of these rows as ``size`` 64-bit words each."""
    out = np.empty((len(rows), size), np.uint64)
    for w in np.unique(words[rows]):
        at = np.flatnonzero(words[rows] == w)
        raw = b"".join(bits[k] for k in rows[at].tolist())
        out[at] = fold_bits(np.frombuffer(raw, np.uint64).reshape(len(at), w), size)
    return out


def _dealt(long: DataFrame, percent: int) -> DataFrame:
    """Entries of long lists in shorter ones, so that two whose sizes are close meet in one at least.

    A size class is a little wider than the threshold's ratio of sizes, so such two are in one class or in neighbours;
    each list takes a class and the next. What is still long is compared by pairs of blocks.
    """
    width = max(math.log(100 / percent) * 1.001, 1e-9)
    at = F.floor(F.log("n") / F.lit(width))
    long = long.withColumn("part", F.explode(F.array(at, at - 1)))
    many = F.ceil(F.col("m") / LIST_TASK).cast("long")
    many = long.groupBy("token", "part").agg(F.count("*").alias("m")).select("token", "part", many.alias("blocks"))
    long = long.join(many, ["token", "part"]).withColumn("block", F.pmod(F.xxhash64("set"), "blocks"))
    long = long.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # Lists that come to share a hash are compared as one.
    return long.select(F.xxhash64("token", "part", F.least("block", "k"), F.greatest("block", "k")).alias("token"), "set", "n", "rest")


def candidates(sets: DataFrame, percent: int) -> DataFrame:
    """``set`` and ``cluster`` of sets that may reach the threshold with another."""
    postings = sets.select("set", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "set", "n", (F.col("n") - F.col("pos")).alias("rest"))
    # A set that differs from any other in too much for its size has no link.
    postings = postings.where(100 * F.col("n") >= percent * (F.col("n") + 1))
    order = ("token", "n", "set")
    # Partial counts, so a long list is a row from each mapper here.
    hot = durable(postings.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > LIST_ROWS).select("token"))
    sweep(sets.sparkSession)
    short = postings.join(hot, "token", "left_anti")
    lists = short.repartition("token").sortWithinPartitions(*order).mapInArrow(lean("ngram_join", _list_rows(percent)), "token long, set long, n long, rest long")
    if not hot.isEmpty():
        lists = lists.unionByName(_dealt(postings.join(hot, "token"), percent))
    with_bits = lists.join(sets.select("set", "bits"), "set").select("token", "set", "n", "rest", "bits")
    edges = with_bits.repartition("token").sortWithinPartitions(*order).mapInArrow(lean("ngram_join", _forest_of_lists(percent)), "a long, b long")
    out = components(edges).toDF("set", "cluster")
    release(hot)
    return out


def _member_filter(members: DataFrame) -> np.ndarray:
    """Bit for each set that is in a cluster, others by chance: MEMBER_BITS bits, whatever the input."""
    slot = F.pmod(F.col("set"), F.lit(MEMBER_BITS)) + 1
    chunks_ = members.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("b")).collect()
    out = np.zeros(MEMBER_BITS // 8, np.uint8)
    for r in chunks_:
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.b), np.uint8)
    return out


def _cluster_links(percent: int):
    """Task of the verification: a forest of links, and how many documents each set links with."""

    def overlaps(own: list[np.ndarray]) -> np.ndarray:
        """Sizes of all intersections, each row derived from the most similar row before it."""
        size = np.array([len(x) for x in own])
        flat = np.concatenate(own)
        kinds, place = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(own)), size)
        by = np.argsort(place, kind="stable")
        members, starts = owner[by], np.searchsorted(place[by], np.arange(len(kinds) + 1))
        rows = np.split(place, np.cumsum(size)[:-1])
        out = np.zeros((len(own), len(own)), np.int64)

        def counted(which: np.ndarray) -> np.ndarray:
            lengths = starts[which + 1] - starts[which]
            at = np.repeat(starts[which] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
            return np.bincount(members[at], minlength=len(own))

        mark = np.zeros(len(kinds), bool)
        for y in range(len(own)):
            apart = size[:y] + size[y] - 2 * out[:y, y]
            if y and apart.min() < size[y]:
                x = int(apart.argmin())
                mark[rows[x]] = True
                new = rows[y][~mark[rows[y]]]
                mark[rows[x]] = False
                mark[rows[y]] = True
                gone = rows[x][~mark[rows[x]]]
                mark[rows[y]] = False
                out[y] = out[x] + counted(new) - counted(gone)
            else:
                out[y] = counted(rows[y])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_runs(batches, "cluster", "i", "j"):
            kinds, aa, bb = [], [], []
            sets, copies, block = (t.column(c).to_numpy() for c in ("set", "copies", "block"))
            i, j = t.column("i").to_numpy(), t.column("j").to_numpy()
            tokens = t.column("tokens")
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                own = [np.frombuffer(x, np.uint64) for x in tokens.slice(lo, hi - lo).to_pylist()]
                size = np.array([len(x) for x in own])
                both = overlaps(own)
                ok = 100 * both >= percent * (size[:, None] + size - both)
                np.fill_diagonal(ok, False)
                if i[lo] != j[lo]:  # each pair is compared in one run only
                    ok &= block[lo:hi, None] != block[None, lo:hi]
                s, many = sets[lo:hi], copies[lo:hi]
                degree = ok @ many
                for k in np.flatnonzero(degree):
                    kinds.append(1)
                    aa.append(int(s[k]))
                    bb.append(int(degree[k]))
                p, q = stars(*np.nonzero(np.triu(ok)), hi - lo)
                kinds += [0] * len(p)
                aa += s[p].tolist()
                bb += s[q].tolist()
            if kinds:
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(aa, pa.int64()), pa.array(bb, pa.int64())], ["kind", "a", "b"])

    return run


def links(docs: DataFrame, text_col: str, words: int, percent: int, levels: np.ndarray, sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """``kind`` 0: ``a`` and ``b`` are linked, enough of these for all components; 1: set ``a`` links with ``b`` documents of other sets."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((levels, _member_filter(clusters)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, member = shared.value
        for b in batches:
            for x, y in chunks(b.column(0)):
                keys, tokens = [], []
                for s in shingle_sets(b.column(0).slice(x, y - x), words):
                    t = ordered(s, level)
                    if len(t):
                        k = set_key(t)
                        slot = k % MEMBER_BITS
                        if member[slot >> 3] >> (slot & 7) & 1:
                            keys.append(k)
                            tokens.append(t.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(tokens, pa.binary())], ["set", "tokens"])

    whole = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(lean("ngram_join", run), "set long, tokens binary")
    whole = whole.groupBy("set").agg(F.first("tokens").alias("tokens"))
    member = clusters.join(sets.select("set", "n", "copies"), "set")
    sizes = member.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("all_n"))
    blocks = F.greatest(F.ceil(F.col("m") / CLUSTER_SETS), F.ceil(F.col("all_n") / CLUSTER_SHINGLES)).cast("long")
    dealt = member.join(sizes.select("cluster", blocks.alias("blocks")), "cluster").withColumn("block", F.pmod(F.xxhash64("set"), "blocks"))
    rows = dealt.join(whole, "set").select("cluster", "set", "copies", "block", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k"))
    rows = rows.select("cluster", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "set", "copies", "block", "tokens")
    key = ("cluster", "i", "j")
    return rows.repartition(*key).sortWithinPartitions(*key, "set").mapInArrow(lean("ngram_join", _cluster_links(percent)), "kind int, a long, b long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: ``id_col``, ``n_shingles``, ``component_id``, ``n_links``.

    Two documents link when ``100 * intersection >= percent * union`` of their sets of ``words``-word
    shingles; a text with fewer words is one shingle. ``component_id`` is the smallest id that is
    reachable by links, ``n_links`` the number of documents linked directly. Texts without
    words, null or empty, have no shingles, no links and their own id as component. Documents
    with equal sets link; repeated rows count as documents of their own. Null ids take part, but
    aren't the smallest; a component of null ids only has a null id. An empty table gives an
    empty result; other columns are ignored.
    """
    out = _classes(docs, id_col, F.lit(None), text_col, words, percent)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")


def _classes(docs: DataFrame, id_col: str, row: Column, text_col: str, words: int, percent: int) -> DataFrame:
    """``id``, ``row``, ``n``, ``component_id``, ``n_links`` and ``keep`` (the ``row`` of its class that stays)."""
    bounded_batches(docs.sparkSession, SMALL_BATCH_BYTES)
    levels = shingle_levels(docs, text_col, words)
    rows = durable(shingled(docs, id_col, row.cast("long"), text_col, words, percent, levels))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    sets = durable(rows.where("set is not null").groupBy("set", "n").agg(F.count("*").alias("copies"), best, F.first("prefix").alias("prefix"), F.first("bits").alias("bits")))
    # Prefixes and bitmaps are in the table of sets now.
    narrow = durable(rows.select("id", "row", "n", "set"))
    release(rows)
    sweep(docs.sparkSession)
    clusters = durable(candidates(sets, percent))
    sweep(docs.sparkSession)
    found = durable(links(docs, text_col, words, percent, levels, sets, clusters))
    comp = durable(components(found.where("kind = 0")))
    degree = found.where("kind = 1").groupBy(F.col("a").alias("set")).agg(F.sum("b").alias("degree"))
    named = sets.join(comp.withColumnRenamed("node", "set"), "set", "left").select("set", "copies", "best", F.coalesce("component", "set").alias("component"))
    smallest = named.groupBy("component").agg(F.min("best").alias("best"))
    answer = durable(named.drop("best").join(smallest, "component").join(degree, "set", "left").select("set", F.col("best.id").alias("component_id"), F.col("best.row").alias("keep"), (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links")))
    for x in (clusters, found, comp, sets):
        release(x)
    some = narrow.where("set is not null").select("id", "row", "n", "set").join(answer, "set").select("id", "row", "n", "component_id", "n_links", "keep")
    none = narrow.where("set is null").select("id", "row", "n", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.col("row").alias("keep"))
    return some.unionByName(none)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id (null ids last); all columns.

    Rows are numbered as they are written first, and judged by that number: rows that share an id
    stay or go each by its own text. Of rows of a component that share the smallest id the first written
    stays. Texts without words are components of their own and stay.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    x = durable(docs.toDF(*own.values()).withColumn("row", F.monotonically_increasing_id()))
    gone = durable(_classes(x, own[id_col], F.col("row"), own[text_col], words, percent).where("row != keep").select("row"))
    sweep(docs.sparkSession)
    return _without(x, gone).select(*own.values()).toDF(*docs.columns)


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` without those whose ``row`` is in ``gone``. Row numbers are dense in each partition, so a broadcast bitmap
    of 4 KB for 32,768 of them says which, and no text is shuffled; where it had over MAX_CHUNKS chunks they are joined."""
    slot = F.col("row") + 1
    bits = durable(gone.groupBy(F.bitmap_bucket_number(slot).alias("_chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits")))
    if bits.count() > MAX_CHUNKS:
        return rows.join(gone, "row", "left_anti")
    asked = rows.withColumn("_chunk", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "_chunk", "left")
    return asked.where(~bit("_bits", F.bitmap_bit_position(slot))).drop("_chunk", "_bits")


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=90)


#: Counts the shingles that each pair shares: a brute force that suits small tables.
OP9_SQL = r"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from w),
flat as (select doc_id, len(s) as n, unnest(s) as x from sets),
pairs as (
    select a.doc_id as a, b.doc_id as b from flat a join flat b on a.x = b.x and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(n, r) as (select doc_id, doc_id from documents union select reach.n, pairs.b from reach join pairs on reach.r = pairs.a),
least as (select n, min(r) as component_id from reach group by n),
degree as (select a, count(*) as n_links from pairs group by a)
select doc_id, len(s)::bigint as n_shingles, component_id, coalesce(n_links, 0) as n_links
from sets join least on n = doc_id left join degree on a = doc_id
"""
