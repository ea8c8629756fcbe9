import functools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm
from tidemark.llm.langid import fold

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def toks(t):
    return [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW)), None]


def base(rows, trained):
    c = Counter(w for (i, t) in rows if trained(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    score = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t))
    return n, {(i, t): (len(toks(t)), sum(c[w] > 0 for w in toks(t)), score(t)) for i, t in rows}


def check(out, rows, trained):
    n, want = base(rows, trained)
    assert len(out) == len(rows)
    for r in out:
        w = want[r.doc_id, r.text]
        assert (r.train_tokens, r.n_tokens, r.n_known) == (n, *w[:2])
        assert abs(r.base_score - w[2]) < 1e-6 * max(1, abs(w[2]))
        assert math.isfinite(r.score) and r.score <= 1e-9


@pytest.mark.parametrize("head", [1 << 17, 50, 0])
def test_base_is_exact(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = lm.score_text(docs, fold(F.col("doc_id"), 10) != 0, keep=("doc_id", "text")).collect()
    check(out, rows, lambda i: zlib.crc32(str(i).encode()) % 10 != 0)


def test_odd_rows(spark):
    rows = [(1, "a b A"), (1, "a b A"), (2, None), (3, ""), (None, "zz a"), (4, "w " * 30_000), (10, "a q")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, bucket string, score int")
    out = lm.score_text(df, F.col("doc_id") < 10, keep=("doc_id", "text")).collect()
    check(out, rows, lambda i: i is not None and i < 10)
    nothing = lm.score_text(df, F.lit(False), keep=("doc_id", "text")).collect()
    check(nothing, rows, lambda i: False)
    assert lm.score_text(df.limit(0), F.lit(True), keep=("doc_id",)).count() == 0


def test_model_prefers_seen_text(spark):
    rows = [(i, f"the cat sat on the mat number{i}") for i in range(50)] + [(100, "the cat sat on the mat"), (101, "mat the on sat cat the")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_text(df, F.col("doc_id") < 100, keep=("doc_id",)).collect()}
    assert got[100].score > got[101].score + 3
    assert got[100].score > got[100].base_score


def u(c):
    return 2 ** math.floor(math.log2(c)) if c else 0


class Brute:
    """The model over dictionaries; words that training hasn't are one unknown word."""

    def __init__(self, texts, order, min_count):
        self.order, self.grams, self.follow, self.texts = order, Counter(), Counter(), len(texts)
        for t in texts:
            w = ["<s>", *toks(t)]
            for i in range(1, len(w)):
                for n in range(1, min(order, i + 1) + 1):
                    self.grams[tuple(w[i - n + 1 : i + 1])] += 1
        self.one = {g[0]: u(c) for g, c in self.grams.items() if len(g) == 1}
        self.grams = {g: u(c) for g, c in self.grams.items() if len(g) > 1 and c >= min_count}
        for g, n in self.grams.items():
            self.follow[g[:-1]] += n

    def p(self, history, w):
        if not history:
            return (self.one.get(w, 0) + 0.1) / (sum(self.one.values()) + 0.1 * (len(self.one) + 1))
        less, f = self.p(history[1:], w), self.follow[history]
        if not f:
            return less
        own = u(self.texts) if history == ("<s>",) else self.one.get(history[0], 0) if len(history) == 1 else self.grams.get(history, 0)
        rest = lm.BACKOFF + max(0, own - f)
        return (self.grams.get((*history, w), 0) + rest * less) / (f + rest)

    def score(self, text):
        w = ["<s>", *toks(text)]
        return sum(math.log10(self.p(tuple(w[max(0, i - self.order + 1) : i]), w[i])) for i in range(1, len(w)))


def model_of(spark, texts, order=lm.ORDER, min_count=lm.MIN_COUNT):
    counts = lm.durable(lm.gather(spark.createDataFrame([(t,) for t in texts], "text string"), lm.PARTS, order, min_count))
    n, v, units, keys, by = lm.summary(counts)
    size = lm.filter_bits(keys)
    return lm.Model(lm.build_filter(counts, size, lm.PARTS), size, lm.head_words(counts, by), n, v, units, len(texts), lm.PARTS, order)


@pytest.mark.parametrize(("order", "min_count"), [(3, 2), (2, 1), (1, 2), (4, 3)])
def test_score_by_brute_force(spark, order, min_count):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(9001, "a b a b c"), (9001, "a b a b c a b"), (9002, None), (9003, "Zz unknown words"), (9004, "x y " * 3000)], docs.schema)
    docs = docs.unionByName(more)
    held = fold(F.col("doc_id"), 10) != 0
    texts = [r.text for r in docs.where(held).collect()]
    brute = Brute(texts, order, min_count)
    brute_one = sum(brute.one.values())
    out = lm.score_text(docs, held, keep=("doc_id", "text"), order=order, min_count=min_count).collect()
    assert len(out) == docs.count() and brute_one > 0
    brute.p = functools.cache(brute.p)
    for r in out:
        assert abs(r.score - brute.score(r.text)) < 1e-6 * max(1, abs(r.score))


@pytest.mark.parametrize(("order", "min_count"), [(3, 2), (3, 1), (2, 2)])
def test_probabilities_sum_to_one(spark, order, min_count):
    """Over the whole vocabulary and one unknown word, after frequent, rare, first and unknown histories."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    m = model_of(spark, texts, order, min_count)
    vocabulary = sorted({w for t in texts for w in toks(t) if w is not None})
    assert len(vocabulary) + 1 == m.kinds
    h = lm.hash_words(pa.array([" ".join([*vocabulary, "never-seen-word"])]))[0]
    last = np.concatenate((h, [lm.END]))
    common = [w for w, _ in Counter(w for t in texts for w in toks(t) if w).most_common(40)]
    for before in ["", common[0], common[20], vocabulary[77], "never-seen", f"{common[0]} {common[1]}", f"{common[3]} {common[0]}", f"{common[1]} nothing", " ".join(toks(texts[5])[:2]), "a b c d"]:
        w = lm.hash_words(pa.array([before]))[0]
        k = len(w)
        tokens = np.empty((len(last), k + 1), np.uint64)
        tokens[:, :k], tokens[:, k] = w, last
        p = 10 ** m.log_probabilities(tokens.ravel(), np.arange(len(last) + 1) * (k + 1)).reshape(-1, k + 1)[:, k]
        assert abs(p.sum() - 1) < 1e-6


def test_filter_holds_every_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.collect()]
    m = model_of(spark, texts)
    for w, n in Counter(w for t in texts for w in toks(t) if w).items():
        if n > 3:
            assert m.words(np.array([lm.hash_words(pa.array([w]))[0][0]]))[0] >= u(n)


def test_filter_follows_the_keys():
    assert lm.filter_bits(0) * lm.PARTS == lm.MIN_BITS
    assert lm.filter_bits(10**7) * lm.PARTS > 0.99 * 10**7 * lm.BITS_A_KEY
    assert lm.filter_bits(10**12) * lm.PARTS <= lm.MAX_BITS


def test_few_bits_only_add(spark, monkeypatch):
    """Beyond the largest filter n-grams are taken for others, none is lost."""
    monkeypatch.setattr(lm, "MIN_BITS", 1 << 12)
    monkeypatch.setattr(lm, "MAX_BITS", 1 << 16)
    texts = [f"the cat sat on mat number {i % 50}" for i in range(400)]
    m = model_of(spark, texts)
    w = lm.hash_words(pa.array(["the cat sat on mat number"]))[0]
    assert (m.words(w) >= 256).all() and lm.filter_bits(10**9) * lm.PARTS == 1 << 16


def test_tokens():
    t, b = lm.tokens_of(pa.array(["a b", "", "c"]))
    assert b.tolist() == [0, 3, 4, 6] and (t[[2, 3, 5]] == lm.END).all()
    two, three = lm.histories(t, b, 3)
    assert two[0].tolist() == list(range(6)) and three[0].tolist() == [1, 2, 5]
    assert two[1][0] == two[1][3] == two[1][4] and len(set(two[1].tolist())) == 4
