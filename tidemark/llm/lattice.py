"""Embedding near-dedup by E8 lattice hashing.

Each table projects unit vectors onto eight random orthonormal directions, scaled so that a length is kept
on average, and decodes the point to the nearest point of the E8 lattice: the vector's home cell.
It also probes the ``PROBES`` neighbouring cells (of the 240 around it) that lie nearest. Two vectors
meet if one's home is the other's home or probe in any of the ``TABLES`` tables, and their cosine is
then computed in double precision. For pairs just at a cosine of 0.98 a table finds 96 %.

A pair is counted once: in the first table where its cells meet, and there in the home cell of the
smaller id if both probe each other. So the tasks send degrees and a forest of links, not pairs.
Cells with many vectors are cut into blocks that are compared two by two. Equal vectors are one
vector with a number of copies.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import bounded_batches
from tidemark.llm.graph import Forest, components, stars
from tidemark.llm.runs import whole_runs
from tidemark.llm.words import mix
from tidemark.storage import durable, release

TABLES, PROBES = 4, 4
#: Side of a cell for unit vectors.
CELL = 0.5
#: Vectors in a block of a cell.
BLOCK = 1024
SEED = 8


def roots() -> np.ndarray:
    """The 240 shortest vectors of the lattice."""
    whole = [(i, j, s, t) for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    out = np.zeros((240, 8))
    for k, (i, j, s, t) in enumerate(whole):
        out[k, i], out[k, j] = s, t
    signs = np.array(list(itertools.product((0.5, -0.5), repeat=8)))
    out[len(whole) :] = signs[(signs < 0).sum(axis=1) % 2 == 0]
    return out


ROOTS = roots()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even sum: where the sum is odd, the worst coordinate goes the other way."""
    near = np.rint(x)
    off = x - near
    odd = near.sum(axis=1) % 2 != 0
    worst = np.abs(off).argmax(axis=1)
    row = np.flatnonzero(odd)
    near[row, worst[row]] += np.where(off[row, worst[row]] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8: the even integer points, and these shifted by a half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _key(points: np.ndarray) -> np.ndarray:
    """64 bits for each lattice point, whose coordinates are halves."""
    out = np.zeros(points.shape[:-1], np.uint64)
    for k in range(8):
        out = mix((out ^ (2 * points[..., k]).astype(np.int64).view(np.uint64)) + np.uint64(k + 1))
    return out.view(np.int64)


_PLANES: dict[int, list] = {}


def tables(dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Directions and shift of each table, the same in every task."""
    if dim not in _PLANES:
        r = np.random.default_rng([SEED, dim])
        out = []
        for _ in range(TABLES):
            q = np.zeros((dim, 8))
            m = min(8, dim)
            q[:, :m] = np.linalg.qr(r.normal(size=(dim, m)))[0]
            out.append((q * np.sqrt(max(dim, 8) / 8) / CELL, r.uniform(0, 1, 8)))
        _PLANES[dim] = out
    return _PLANES[dim]


def cells(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home (rows x tables) and probed cells (rows x tables x probes) of unit vectors."""
    home, probe = [], []
    for q, shift in tables(unit.shape[1]):
        x = unit @ q + shift
        h = decode(x)
        # The nearest neighbours of the home are the roots that point most the way of the rest.
        near = np.argsort(-((x - h) @ ROOTS.T), axis=1, kind="stable")[:, :PROBES]
        home.append(_key(h))
        probe.append(_key(h[:, None, :] + ROOTS[near]))
    return np.stack(home, axis=1), np.stack(probe, axis=1)


def unit_rows(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``id``, ``label``, ``vec`` (doubles as bytes; null if it can't link)."""
    kinds = dict(vectors.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column("v").to_pylist():
                x = np.array(v, "<f8") if v and None not in v else np.zeros(1)
                scale = np.abs(x).max()
                # Scaled, so that neither a tiny nor a huge vector loses its direction.
                out.append((x / scale).tobytes() if np.isfinite(x).all() and scale > 0 else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(out, pa.binary())], ["id", "label", "vec"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"id {kinds[id_col]}, label {kinds[label_col]}, vec binary")


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each vector, table and cell; ``probed`` 0 for the home."""
    for b in batches:
        raw = np.array(b.column("vec").to_pylist(), object)
        size = np.array([len(x) for x in raw])
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            home, probe = cells(unit_rows(raw[at].tolist()))
            all_ = np.concatenate((home[:, :, None], probe), axis=2)
            each = all_.shape[1] * all_.shape[2]
            take = pa.array(np.repeat(at, each))
            table = np.tile(np.repeat(np.arange(TABLES), PROBES + 1), len(at))
            probed = np.tile(np.arange(PROBES + 1) > 0, len(at) * TABLES).astype(np.int32)
            cell = mix((all_.reshape(-1).view(np.uint64) ^ np.uint64(n)) + table.astype(np.uint64)).view(np.int64)
            cols = [b.column(c).take(take) for c in ("group", "node")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(table, pa.int32()), pa.array(cell, pa.int64()), pa.array(probed, pa.int32())], ["group", "node", "t", "cell", "probed"])


DEALT = "group long, node long, t int, cell long, probed int"


def _linked(cosine: float):
    """Task over blocks of cells: a forest of links (kind 0), and degrees (kind 1)."""

    def first_meeting(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, t: int, here: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Whether the pairs (i, j) are to be counted here, in table t."""
        (hx, px), (hy, py) = x, y
        meets = (hx[i] == hy[j]) | (px[i] == hy[j][:, :, None]).any(axis=2) | (py[j] == hx[i][:, :, None]).any(axis=2)
        earlier = meets[:, :t].any(axis=1)
        # Both homes may be cells of this table where the pair meets; the smaller id's goes first.
        at_x = (hx[i, t] == hy[j, t]) | (py[j, t] == hx[i, t][:, None]).any(axis=1)
        at_y = (hx[i, t] == hy[j, t]) | (px[i, t] == hy[j, t][:, None]).any(axis=1)
        low = np.where(node[i] < node[j], hx[i, t], hy[j, t])
        low_ok = np.where(node[i] < node[j], at_x, at_y)
        high = np.where(node[i] < node[j], hy[j, t], hx[i, t])
        return ~earlier & (np.where(low_ok, low, high) == here)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for tab, bounds in whole_runs(batches, "group", "t", "cell", "i", "j"):
            kinds, aa, bb = [], [], []
            node, copies, probed, table, block = (tab.column(c).to_numpy() for c in ("node", "copies", "probed", "t", "block"))
            bi, bj = tab.column("i").to_numpy(), tab.column("j").to_numpy()
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo < 2 or not (probed[lo:hi] == 0).any():
                    continue
                raw = tab.column("vec").slice(lo, hi - lo).to_pylist()
                unit = unit_rows(raw)
                close = unit @ unit.T >= cosine - 1e-9
                p = probed[lo:hi]
                close &= (p[:, None] == 0) | (p == 0)  # two that only probe this cell meet elsewhere, or not
                if bi[lo] != bj[lo]:
                    close &= block[lo:hi, None] != block[None, lo:hi]
                i, j = np.nonzero(np.triu(close, 1))
                i, j = i[node[lo + i] != node[lo + j]], j[node[lo + i] != node[lo + j]]
                if not len(i):
                    continue
                used = np.unique(np.concatenate((i, j)))
                exact = (unit[i] * unit[j]).sum(axis=1) >= cosine
                i, j = i[exact], j[exact]
                if not len(i):
                    continue
                of = cells(unit[used])
                place = np.searchsorted(used, np.arange(len(unit)))
                homes = np.zeros(hi - lo, np.int64)
                homes[used] = of[0][:, table[lo]]
                here = homes[np.flatnonzero(p == 0)[0]] if (p[used] == 0).any() and np.flatnonzero(p == 0)[0] in used else homes[used[p[used] == 0][0]]
                mine = first_meeting(of, of, place[i], place[j], int(table[lo]), here, node[lo:hi][used])
                i, j = i[mine], j[mine]
                degree = np.bincount(i, copies[lo + j], hi - lo) + np.bincount(j, copies[lo + i], hi - lo)
                for k in np.flatnonzero(degree):
                    kinds.append(1)
                    aa.append(int(node[lo + k]))
                    bb.append(int(degree[k]))
                i, j = stars(i, j, hi - lo)
                for a, b in zip(node[lo + i].tolist(), node[lo + j].tolist(), strict=True):
                    if forest.join(a, b):
                        kinds.append(0)
                        aa.append(a)
                        bb.append(b)
            if kinds:
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(aa, pa.int64()), pa.array(bb, pa.int64())], ["kind", "a", "b"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """One row for each input row: ``id_col``, ``n_links``, ``component_id``, ``kept``.

    Rows with equal labels link if the cosine of their vectors, in double precision, is at least
    ``cosine``. ``component_id`` is the smallest id that is reachable by links, ``kept`` whether it is
    the row's own. Null labels and vectors that are null, empty, zero, or hold null, NaN or infinite
    components link with nothing; their component is their own id. Vectors of different
    lengths don't link. Rows with equal ids count as rows of their own. Null ids take part, but
    aren't the smallest; where all ids are null the component is null, and kept is true. An
    empty table gives an empty result; other columns are ignored.
    """
    bounded_batches(vectors.sparkSession)
    rows = durable(_vectors(vectors, id_col, vec_col, label_col).withColumn("node", F.when(F.col("vec").isNotNull() & F.col("label").isNotNull(), F.xxhash64("label", "vec"))))
    # Equal vectors of a label are one node: a partial aggregate, so a hot vector is a row for each mapper.
    nodes = durable(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("label").alias("label"), F.first("vec").alias("vec")))
    # Cells travel without vectors; those join the cells that more than one vector is in.
    dealt = durable(nodes.select(F.xxhash64("label").alias("group"), "node", "vec").mapInArrow(_deal, DEALT))
    key = ["group", "t", "cell"]
    sizes = dealt.groupBy(*key).agg(F.count("*").alias("m"), F.min("probed").alias("home")).where("m > 1 and home = 0")
    placed = dealt.join(sizes.select(*key, F.ceil(F.col("m") / BLOCK).alias("blocks")), key).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    spread = placed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"i": F.least("block", "k"), "j": F.greatest("block", "k")}).drop("k", "blocks").join(nodes.select("node", "copies", "vec"), "node")
    found = durable(spread.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j", "node", "probed").mapInArrow(_linked(cosine), "kind int, a long, b long"))
    release(dealt)
    comp = durable(components(found.where("kind = 0")))
    degree = found.where("kind = 1").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("degree"))
    named = nodes.join(comp, "node", "left").select("node", "copies", "least", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = durable(named.join(smallest, "component").join(degree, "node", "left").select("node", "component_id", (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links")))
    some = rows.where("node is not null").select("id", "node").join(answer, "node").select("id", "n_links", "component_id")
    none = rows.where("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return some.unionByName(none).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op1_lattice_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label: a brute force that suits small tables.
OP1_SQL = """
with recursive v as (
    select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
    where label is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
      and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
    where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(n, r) as (select vec_id, vec_id from embeddings union select reach.n, pairs.b from reach join pairs on reach.r = pairs.a),
least as (select n, min(r) as component_id from reach group by n),
degree as (select a, count(*) as n_links from pairs group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join least on n = vec_id left join degree on a = vec_id
"""
