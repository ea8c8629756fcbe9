"""Toxicity by compression distance.

A text is cut into overlapping windows of ``WORDS`` words. Two zstandard dictionaries are trained: one on
windows of ordinary text, one on windows of toxic text. A window is compressed once with the
ordinary dictionary and once with the toxic one in front of it; the bytes that are saved, as a share of
what the ordinary dictionary needs, are the window's distance. The part that both share lies at the
same place in both, so a window without anything toxic compresses to about the same length.

Toxic documents consist mostly of ordinary text. So the toxic dictionary is trained on residuals:
windows of toxic text without the words that the ordinary dictionary (and what the toxic one has
so far) compresses to few bytes; this is repeated ``PARTS`` times. And the ordinary dictionary is given the windows of
ordinary text in which the toxic one saved bytes all the same, ``ROUNDS`` times.

zstandard spends some 5 bytes on any match, which hides matches of short words; every byte is written as
two (the second a fixed function of the first), which doubles what a match saves.

A document's score is a logistic function of its windows' distances (largest, second largest, mean,
bytes saved), calibrated on labelled training rows that the dictionaries were not trained on (one in
``CALIBRATE``, by a hash of the id), so that the threshold is where an F-score that weighs precision more (``BETA``) is best.

The model is fitted on a bounded sample of labelled rows: about ``sample_docs`` whole toxic documents and
``ORDINARY`` times as many others, by a hash of the id, and of their windows about ``FIT_BYTES`` for
each class, by a hash of the window. The sample stays in a table; what the driver gets are dictionaries
of bounded size and a few numbers for each sampled document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import bounded_batches
from tidemark.llm.langid import fold
from tidemark.storage import durable, release

#: Toxic documents that the model is fitted on, about, and ordinary ones for each of them.
SAMPLE_DOCS, ORDINARY = 3000, 2
#: One in so many of these is kept apart, for the calibration.
CALIBRATE = 4
#: Bytes of windows of each class that dictionaries are trained on, about.
FIT_BYTES = 16_000_000
#: Words in a window, and from the start of one to the start of the next; a window is cut every MAX_WINDOW bytes.
WORDS, STRIDE, MAX_WINDOW = 32, 28, 2048
#: Bytes of the ordinary dictionary as trained, at most as many of hard windows, and of each part of the toxic one.
ORDINARY_BYTES, HARD_BYTES, TOXIC_BYTES = 400_000, 800_000, 12_000
#: Parts of the toxic dictionary, rounds of hard windows, and words in the narrow windows of a round.
PARTS, ROUNDS, NARROW = 4, 2, 8
#: A word that takes fewer bytes alone is one match: the dictionary knows it.
COST = 17
#: A narrow ordinary window in which so many bytes or more are saved is hard.
HARD = 1
LEVEL = 16
#: Bytes of the runs that only the toxic dictionary has, and bits of the table of them.
PIECE, PIECE_BITS = 4, 22
#: Score from which a document counts as toxic.
THRESHOLD = 0.7
#: Weight of recall against precision in the choice of the threshold.
BETA = 0.5
#: Numbers that describe a document.
FEATURES = 5

_TWICE = np.arange(256, dtype=np.uint8)[:, None].repeat(2, axis=1)
_TWICE[:, 1] = _TWICE[:, 1] * 3 + 37


def doubled(x: bytes) -> bytes:
    return _TWICE[np.frombuffer(x, np.uint8)].tobytes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def window_at(w: list[bytes], at: int, words: int = WORDS) -> list[bytes]:
    """The window that begins with this word, in parts of at most MAX_WINDOW bytes."""
    x = b" " + b" ".join(w[at : at + words]) + b" "
    return [x[i : i + MAX_WINDOW] for i in range(0, len(x), MAX_WINDOW)]


def windows(text: str | None, words: int = WORDS, stride: int = STRIDE) -> list[bytes]:
    """Overlapping windows of lower-cased words; the last one ends with the text. A text without words has none."""
    w = words_of(text)
    return [x for at in range(0, max(1, len(w) - (words - stride)), stride) for x in window_at(w, at, words)] if w else []


def compressor(content: bytes):
    """Lengths under a dictionary with this content; frames without optional fields: only the block counts."""
    import zstandard as zstd

    p = zstd.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS, window_log=23)
    d = zstd.ZstdCompressionDict(doubled(content), dict_type=zstd.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstd.ZstdCompressor(dict_data=d, compression_params=p)


def pieces(content: bytes) -> np.ndarray:
    """Every run of PIECE bytes, as a number, at its place."""
    x = np.frombuffer(content, np.uint8)
    n = len(x) - PIECE + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(PIECE if n > 0 else 0):
        out |= x[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return out


def _slot(piece: np.ndarray) -> np.ndarray:
    return (piece * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PIECE_BITS)).astype(np.int64)


class Distance:
    """Compression lengths under the ordinary dictionary, without and with the toxic one before it.

    A window that has no run of PIECE bytes which only the toxic dictionary has is at distance 0: matches there
    gain nothing. It isn't compressed, which is why ordinary text costs little. (The runs are kept by
    a hash; one that falls on another's place is compressed for nothing.)
    """

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.plain, self.with_toxic = compressor(ordinary), compressor(toxic + ordinary)
        own = pieces(toxic)
        self.own = np.zeros(1 << PIECE_BITS, bool)
        self.own[_slot(own[~np.isin(own, pieces(ordinary))])] = True

    def lengths(self, window: bytes) -> tuple[int, int]:
        x = doubled(window)
        return len(self.plain.compress(x)), len(self.with_toxic.compress(x))

    def near(self, content: bytes) -> np.ndarray:
        """Where in the content there is a run that only the toxic dictionary has."""
        return np.flatnonzero(self.own[_slot(pieces(content))])

    def saved(self, window: bytes) -> int:
        if not len(self.near(window)):
            return 0
        a, b = self.lengths(window)
        return a - b

    def features(self, text: str | None) -> list[float]:
        """Largest, second largest and mean distance, and bytes saved (by their logarithm) at most and in all."""
        w = words_of(text)
        if not w:
            return [0.0] * FEATURES
        at = self.near(b" " + b" ".join(w) + b" ")
        if not len(at):
            return [0.0] * FEATURES
        # Words that a run touches, and the windows that they are in.
        starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in w])))
        touched = np.unique(np.clip(np.concatenate((np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, at + PIECE - 1, "right") - 1)), 0, len(w) - 1))
        n = len(range(0, max(1, len(w) - (WORDS - STRIDE)), STRIDE))
        some = sorted({i for k in touched.tolist() for i in range(max(0, -(-(k - WORDS + 1) // STRIDE)), min(n - 1, k // STRIDE) + 1)})
        both = np.array([self.lengths(x) for i in some for x in window_at(w, i * STRIDE) if len(self.near(x))], float).reshape(-1, 2)
        if not len(both):
            return [0.0] * FEATURES
        saved = both[:, 0] - both[:, 1]
        far = np.sort(saved / both[:, 0])[::-1]
        gain = np.maximum(saved - 1, 0)
        return [max(0.0, far[0]), max(0.0, far[1]) if len(far) > 1 else 0.0, np.maximum(far, 0).sum() / n, float(np.log1p(gain.max())), float(np.log1p(gain.sum()))]


_DISTANCES: dict[tuple[bytes, bytes], Distance] = {}


def worker_distance(toxic: bytes, ordinary: bytes) -> Distance:
    """The worker's own, which outlives a task; only the last model's is kept."""
    if (toxic, ordinary) not in _DISTANCES:
        _DISTANCES.clear()
        _DISTANCES[toxic, ordinary] = Distance(toxic, ordinary)
    return _DISTANCES[toxic, ordinary]


def trained(samples: list[bytes], size: int, segment: int, part: int) -> bytes:
    """Content of a zstandard dictionary trained on the samples; too few to train on are taken as they are."""
    import zstandard as zstd

    try:
        return zstd.train_dictionary(size, samples, k=segment, d=part).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def narrow(window: bytes) -> list[bytes]:
    w = window.split()
    return [b" " + b" ".join(w[i : i + NARROW]) + b" " for i in range(0, len(w), NARROW)]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary, from windows of either class (sorted here: their order doesn't count)."""
    toxic, ordinary = sorted(toxic), sorted(ordinary)
    if not toxic or not ordinary:
        return b"", b""
    # Sorted windows begin alike; training looks at stretches of the samples, so they are mixed.
    for x in (toxic, ordinary):
        np.random.default_rng(len(x)).shuffle(x)
    base, mine = trained(ordinary, ORDINARY_BYTES, 64, 8), b""
    for _ in range(PARTS):
        known, cost = compressor(mine + base), {}

        def dear(word: bytes, known=known, cost=cost) -> bool:
            if word not in cost:
                cost[word] = len(known.compress(doubled(b" " + word[:64] + b" ")))
            return cost[word] >= COST

        rest = [b"".join(b" " + w + b" " for w in x.split() if dear(w)) for x in toxic]
        rest = [x for x in rest if x]
        if not rest:
            break
        mine = trained(rest, TOXIC_BYTES, 24, 6) + mine
    small = [x for w in ordinary for x in narrow(w)]
    room = HARD_BYTES
    for _ in range(ROUNDS):
        d = Distance(mine, base)
        hard = b"".join(x for x in small if d.saved(x) >= HARD)[:room]
        room -= len(hard)
        base = hard + base
    return mine, base


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights of a ridge-regularised logistic regression by Newton's method; the last is the bias."""
    x = np.column_stack((x, np.ones(len(x))))
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def cut_at(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The value of ``z`` from which on calling documents toxic has the best F-score (BETA), each counted ``weight`` times."""
    order = np.argsort(-z, kind="stable")
    z, hit, miss = z[order], np.cumsum((weight * (y == 1))[order]), np.cumsum((weight * (y == 0))[order])
    last = np.concatenate((z[1:] != z[:-1], [True]))  # equal values are on one side
    score = np.where(last, (1 + BETA**2) * hit / (BETA**2 * hit[-1] + hit + miss), -1.0)
    best = int(score.argmax())
    return float((z[best] + z[best + 1]) / 2) if best + 1 < len(z) else float(z[best] - 1)


def train(labelled: DataFrame, id_col: str, text_col: str, label_col: str, sample_docs: int = SAMPLE_DOCS, threshold: float = THRESHOLD, fit_bytes: int = FIT_BYTES) -> tuple[bytes, bytes, np.ndarray] | None:
    """Dictionaries and calibration from labelled rows; None unless both classes have words in either part.

    Repeated windows count once.
    """
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y")).where("i is not null and text is not null and y in (0, 1)")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("y") == 1, min(1.0, sample_docs / sizes[1])).otherwise(min(1.0, ORDINARY * sample_docs / sizes[0]))
    picked = rows.where(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < share * (1 << 20))
    picked = durable(picked.select("text", "y", (F.pmod(F.xxhash64("i", F.lit(7)), F.lit(CALIBRATE)) == 0).alias("apart")))
    volume = {r.y: r.n for r in picked.where("not apart").groupBy("y").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    rate = {y: min(1.0, fit_bytes / max(1, volume.get(y) or 0)) for y in (0, 1)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own: dict[int, set[bytes]] = {0: set(), 1: set()}
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                own[y].update(w for w in windows(text, WORDS, WORDS) if zlib.crc32(w) < rate[y] * (1 << 32))
            yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([list(own[0]), list(own[1])], pa.list_(pa.binary()))], ["y", "w"])

    def fit(group: pa.Table) -> pa.Table:
        """One task: the windows are about 2 * FIT_BYTES."""
        own: dict[int, set[bytes]] = {0: set(), 1: set()}
        for y, w in zip(group.column("y").to_pylist(), group.column("w").to_pylist(), strict=True):
            own[y].update(w)
        mine, base = dictionaries(list(own[1]), list(own[0]))
        return pa.table({"toxic": pa.array([mine], pa.binary()), "ordinary": pa.array([base], pa.binary())})

    parts = picked.where("not apart").select("text", "y").mapInArrow(cut, "y int, w array<binary>")
    got = parts.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(fit, "toxic binary, ordinary binary").collect()
    model = (bytes(got[0].toxic), bytes(got[0].ordinary)) if got else (b"", b"")
    if not all(model):
        return None
    shared = picked.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [worker_distance(*shared.value).features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    found = picked.where("apart").select("text", "y").repartition(16).mapInArrow(measure, "y int, x array<double>").collect()
    release(picked)
    if len({r.y for r in found}) < 2:
        return None
    # In a fixed order, so that sums of floats come out alike.
    found = np.array(sorted((r.y, *r.x) for r in found))
    x, y = found[:, 1:], found[:, 0]
    w = calibrate(x, y)
    # The classes were sampled at different rates; the threshold is the best one for the rates of all rows.
    z = np.column_stack((x, np.ones(len(x)))) @ w
    w[-1] += np.log(threshold / (1 - threshold)) - cut_at(z, y, np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum()))
    return *model, w


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train_rows: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    keep: tuple[str, ...] = (),
    sample_docs: int = SAMPLE_DOCS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row for each input row: ``keep``, ``score`` (0 to 1) and ``predicted``.

    The model learns from rows of ``docs`` where ``train_rows`` is true, joined with ``labels`` on
    ``id_col``; rows with a null id, text or label are left out, repeated rows count as one. Null and
    empty texts have no window and get the score of a text without any distance. If the labels
    hold fewer than two classes, with words, in either part of the sample, every score is 0. Rows are
    independent; long texts are scored whole; an empty table gives an empty result; other columns, of
    either table, are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).dropna().distinct()
    mine = docs.where(train_rows).select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    # Labels are many: their ids are sampled on either side before the join moves any text.
    model = train(_sampled(mine, marks, sample_docs), "_doc", "_text", "_label", sample_docs, threshold)
    shared = spark.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    named = [f"_k{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{a} {kinds[c]}" for a, c in zip(named, keep, strict=True)), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        distance = worker_distance(*fitted[:2]) if fitted else None
        for b in batches:
            if fitted is None:
                scores = np.zeros(b.num_rows)
            else:
                x = np.array([distance.features(t) for t in b.column("_text").to_pylist()]).reshape(-1, FEATURES)
                scores = 1 / (1 + np.exp(-np.clip(np.column_stack((x, np.ones(len(x)))) @ fitted[2], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b.column(a) for a in named), pa.array(scores, pa.float64())], [*named, "score"])

    rows = docs.select(*(F.col(c).alias(a) for a, c in zip(named, keep, strict=True)), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(run, schema).withColumnsRenamed(dict(zip(named, keep, strict=True)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _sampled(docs: DataFrame, marks: DataFrame, sample_docs: int) -> DataFrame:
    """Labelled documents, thinned by label before the join, so that no text is shuffled.

    Not every label has a row of ``docs``, so twice the sample is kept for each class: the
    broadcast side has about 4 * ORDINARY * sample_docs ids at most.
    """
    most = 2 * ORDINARY * sample_docs
    marks = marks.where(F.col("_label").cast("int").isin(0, 1))
    sizes = {r._label: r.n for r in marks.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for label, n in sizes.items():
        share = F.when(F.col("_label") == label, min(1.0, most / n)).otherwise(share)
    picked = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < share * (1 << 20))
    return docs.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).drop("_id")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, labels, fold(F.col("doc_id"), 3) != 1, keep=("doc_id", "held_out"))
