import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid as L

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_em_matches_slow_em():
    r = np.random.default_rng(1)
    p = r.dirichlet(np.ones(40), 2).T
    n = r.multinomial(4000, p @ [0.7, 0.3]).astype(float)
    w = np.array([0.5, 0.5])
    for _ in range(500):
        resp = p * w / (p * w).sum(1, keepdims=True)
        w = (n[:, None] * resp).sum(0) / n.sum()
    assert np.allclose(L._em(p, n, 500)[0], w, atol=0.05)
    assert abs(w[0] - 0.7) < 0.05


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    out = L.identify(docs, L.fold(F.col("doc_id"), 3) != 1, keep=("doc_id", "lang")).where(L.fold(F.col("doc_id"), 3) == 1).toPandas()
    assert len(out) > 250
    assert (out.lang == out.lang_pred).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_mixture_of_two(spark):
    docs = spark.read.parquet(DOCS)
    two = docs.where("length(text) > 800").groupBy("lang").agg(F.max("text").alias("t")).toPandas().set_index("lang").t
    text = two["de"][:800] + " " + two["es"][:800]
    df = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-1, text, None)], "doc_id long, text string, lang string"))
    langs = L.identify(df, F.col("doc_id") >= 0, keep=("doc_id",)).where("doc_id = -1").first().langs
    assert set(langs) == {"de", "es"} and abs(langs["de"] - 0.5) < 0.15


def test_odd_rows(spark):
    rows = [(1, "der und die", "de", "x"), (2, "the and of", "en", "y"), (None, "the and", None, None), (3, None, "en", "z"), (4, "", "de", "z"), (5, "12 !!", None, "q"), (1, "der und die", "de", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = L.identify(df, F.lit(True), keep=("doc_id", "score")).collect()
    assert len(out) == 7
    pred = [r.lang_pred for r in sorted(out, key=lambda r: (r.doc_id or 0))]
    assert pred == ["en", "de", "de", "en", "und", "und", "und"]
    none = L.identify(df.withColumn("lang", F.lit(None).cast("string")), F.lit(True), keep=("doc_id",)).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert L.identify(df.limit(0), F.lit(True), keep=("doc_id",)).count() == 0


@pytest.mark.parametrize("text", ["", "...", "a", "ñandú", "日本語"])
def test_trigrams_count_letters(text):
    assert len(L.trigrams(text)) == sum(c.isalpha() for c in text.lower())


def test_more_languages_than_a_few_hundred(spark):
    """Each of 300 languages writes with its own letters."""
    word = lambda k: chr(0x4E00 + 7 * k) + chr(0x4E01 + 7 * k) + chr(0x4E02 + 7 * k)
    rows = [(3 * k + j, f"{word(k)} {word(k)}", f"l{k:03d}") for k in range(300) for j in range(2)]
    out = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), keep=("lang",)).collect()
    assert len(out) == 600 and all(r.lang == r.lang_pred for r in out)


def test_ties_and_very_long_texts(spark):
    rows = [(1, "aaa", "x"), (2, "aaa", "w"), (3, "bbb", "x"), (4, "bbb", "w"), (5, "aaa bbb " * 60_000, None)]
    out = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), keep=("doc_id",)).collect()
    assert {r.lang_pred for r in out} == {"w"} and all(0 < r.score <= 1 for r in out)
