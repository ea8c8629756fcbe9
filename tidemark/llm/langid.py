"""Language ID by multilingual mixture inference.

A document is a mixture of languages. Each learned language gives every character trigram a
probability; expectation-maximisation finds the proportions under which the document's trigrams
are likeliest. The language set grows one language at a time, as long as the gain in
log-likelihood exceeds a penalty (``penalty`` times half the log of the trigram count for
each added language, trigrams overlapping).

Trigrams are hashed to ``BUCKETS`` classes, so a language is a vector of fixed length; the broadcast
model has 256 KB for each language that the labels name (float32), whatever the size of the input. It is fitted
on a bounded sample: about ``sample_docs`` whole documents of each language, by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import SMALL_BATCH_BYTES, bounded_batches, lean
from tidemark.llm.words import mix

BUCKETS = 1 << 16
#: Labelled documents of each language that are read for the model, about.
SAMPLE_DOCS = 3000
#: Added to each trigram count.
ALPHA = 0.05
#: Weight of the penalty for each language beyond the first.
PENALTY = 8.0
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def trigrams(text: str) -> np.ndarray:
    """Bucket of each trigram around a letter; what isn't a letter counts as a space."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[c]
    c = np.where(letter, c, 32).astype(np.uint64)
    at = np.flatnonzero(letter)
    if not len(at):
        return np.empty(0, np.int64)
    return (mix(c[at - 1] | (c[at] << np.uint64(21)) | (c[at + 1] << np.uint64(42))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _em(p: np.ndarray, n: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of counts ``n`` under the columns of ``p``."""
    w, total = np.full(p.shape[1], 1 / p.shape[1]), n.sum()
    for _ in range(steps):
        new = w * ((n / (p @ w)) @ p) / total
        moved = np.abs(new - w).max()
        w = new
        if moved < 1e-3:
            break
    return w, float(n @ np.log(p @ w))


def mixture(grams: np.ndarray, p: np.ndarray, penalty: float = PENALTY, steps: int = 30) -> dict[int, float]:
    """Proportion of each selected language (a column of ``p``)."""
    kinds, n = np.unique(grams, return_counts=True)
    rows, n = p[kinds].astype(float), n.astype(float)
    single = n @ np.log(rows)
    chosen, w, best = [int(single.argmax())], np.ones(1), float(single.max())
    cost = penalty * 0.5 * np.log(n.sum() + 1)
    while len(chosen) < p.shape[1]:
        rest = [j for j in range(p.shape[1]) if j not in chosen]
        # A language can only help where it beats the present mixture; the most promising is tried.
        now = rows[:, chosen] @ w
        gain = [float(n @ np.log(0.8 * now + 0.2 * rows[:, j])) for j in rest]
        j = rest[int(np.argmax(gain))]
        v, ll = _em(rows[:, [*chosen, j]], n, steps)
        if ll - best <= cost:
            break
        chosen, w, best = [*chosen, j], v, ll
    return dict(zip(chosen, w.tolist(), strict=True))


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % parts


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities (BUCKETS x languages) from labelled rows."""
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return [], np.empty((BUCKETS, 0))
    share = labelled.sparkSession.createDataFrame([(r.lang, min(1.0, sample_docs / r.n)) for r in sizes], "lang string, share double")
    picked = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + np.bincount(trigrams(text), minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "counts": pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())})

    # The sample is bounded, so this is too: a row for each language and task. Rows are dealt in turn, so that no
    # language lies in one task.
    got = picked.select("lang", "text").repartition(8).mapInArrow(lean("langid", count), "lang string, counts binary").collect()
    total: dict[str, np.ndarray] = {}
    for r in got:
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(r.counts, "<i8")
    langs = sorted(k for k, v in total.items() if v.sum())
    if not langs:
        return [], np.empty((BUCKETS, 0))
    c = np.stack([total[k] for k in langs], axis=1) + ALPHA
    return langs, (c / c.sum(axis=0)).astype(np.float32)


def identify(
    docs: DataFrame,
    train_rows: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    keep: tuple[str, ...] = (),
    sample_docs: int = SAMPLE_DOCS,
    penalty: float = PENALTY,
) -> DataFrame:
    """One row for each input row: ``keep``, ``lang_pred``, ``score``, ``langs``.

    ``train_rows`` says which rows of ``docs`` the model may learn from (null: no); of these, rows
    with a null id, text or language are left out. ``lang_pred`` is the language with the largest
    proportion (``score``), ties by name; ``langs`` maps the selected languages to their
    proportions. Null texts, texts without a letter, and all texts where nothing could be
    learned get ``und``, score 0 and no languages. Rows are independent, so repeated rows get the
    same answer each; an empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark, SMALL_BATCH_BYTES)
    langs, p = train(docs.where(train_rows), id_col, text_col, lang_col, sample_docs)
    model = spark.sparkContext.broadcast((langs, p))
    kinds = dict(docs.dtypes)
    named = [f"_k{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{a} {kinds[c]}" for a, c in zip(named, keep, strict=True)), "lang_pred string, score double, langs map<string,double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        for b in batches:
            pred, score, found = [], [], []
            for text in b.column("_text").to_pylist():
                g = trigrams(text) if text and names else ()
                w = mixture(g, table, penalty) if len(g) else {}
                by = {names[j]: v for j, v in w.items()}
                top = min(by, key=lambda k: (-by[k], k), default=UNKNOWN)
                pred.append(top)
                score.append(min(1.0, by.get(top, 0.0)))
                found.append(list(by.items()))
            more = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(found, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(a) for a in named), *more], [*named, "lang_pred", "score", "langs"])

    rows = docs.select(*(F.col(c).alias(a) for a, c in zip(named, keep, strict=True)), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(lean("langid", run), schema)
    return out.withColumnsRenamed(dict(zip(named, keep, strict=True)))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)))
    out = identify(rows, fold(F.col("doc_id"), 3) != 1, keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score")
