import hashlib

import corpus_pipeline as C
import numpy as np
from test_bpe import brute as encode
from test_mixing import brute as mix
from test_ngram_join import brute as join

from tidemark.llm import mixing as M

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    kept = C.keep_languages(spark, docs, D)
    assert kept.columns == columns
    rows = {r.doc_id: r for r in kept.collect()}
    clean = {r.doc_id for r in docs.collect() if sum(c.isalpha() for c in r.text or "") > 50}
    assert len(clean - set(rows)) <= 0.01 * len(clean)

    best = {}
    for r in rows.values():
        best[r.text] = max(r.doc_id, best.get(r.text, -1))
    out = C.drop_exact_copies(spark, kept, D)
    assert out.columns == columns and {r.doc_id for r in out.collect()} == set(best.values())

    near = C.drop_near_copies(spark, out, D)
    want = {d for d, _, c, _ in join([(i, rows[i].text) for i in best.values()], 5, 80) if d == c}
    assert near.columns == columns and {r.doc_id for r in near.collect()} == want

    mixed = C.mix_sources(spark, near, D)
    copies = {d: n for d, *_, n in mix([(i, rows[i].text, rows[i].lang, rows[i].source) for i in want], M.WEIGHTS, M.SHARE_PERCENT, M.MAX_EPOCHS, M.SEED)}
    got = [r.doc_id for r in mixed.collect()]
    assert mixed.columns == columns and {i: got.count(i) for i in got} == copies

    for r in C.encode(spark, mixed, D).collect():
        ids = encode(rows[r.doc_id].text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run(spark):
    out = C.run(spark, D)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    assert 4 <= len(C.STAGES) <= 5


def test_clashing_columns_and_odd_rows(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars", "score", "lang_pred", "langs", "_gone", "_n", "_id", "_copies", "c1", "copies", "set"]
    words = "the of and that with from this have are was"
    rows = [(i, f"{words} w{i % 7} and v{i}", "en", "src0") for i in range(30)] + [(40, None, None, None), (None, words * 3, "en", None), (41, "", "de", "x"), (42, "123 !", "de", "x"), (3, f"{words} w3 and v3", "en", "src0")]
    df = spark.createDataFrame([(*r, len(r[1] or ""), *"abcdefghij") for r in rows], ", ".join(f"{n} {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))
    out = df
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, out, D)
        assert out.columns == names
    assert out.count() > 0 and {40, 41, 42}.isdisjoint(r.doc_id for r in out.collect())
    assert C.STAGES[-1][1](spark, out, D).count() == out.count()
    empty = df.limit(0)
    for _, stage in C.STAGES:
        empty = stage(spark, empty, D)
    assert empty.count() == 0
