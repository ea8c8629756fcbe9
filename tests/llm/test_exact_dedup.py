import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_oracle import compare

from tidemark.llm import exact_dedup as X


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    keep = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return sorted(((i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "x" * 300 + "1"), (6, "x" * 300 + "2"), (7, "x" * 300 + "1"), (None, "a"), (None, "n"), (9, "b"), (9, "b"), (10, "é" * 70_000), (11, "é" * 70_000)]


def test_cases(spark):
    df = spark.createDataFrame([(*r, 1, "z", True) for r in ROWS], "doc_id long, text string, len int, id string, kept boolean")
    out = X.exact_dedup(df, carry={"text_sha256": lambda t: F.sha2(t, 256)})
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(ROWS)


def test_empty(spark):
    assert X.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_drop_copies(spark):
    df = spark.createDataFrame([(1, "a", "s"), (2, "a", "t"), (3, "b", None)], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in X.drop_copies(df).collect()) == [2, 3]
    assert X.drop_copies(df).columns == df.columns


def kept(rows):
    """For each text the largest (id, source), nulls last."""
    best = {}
    for i, t, s in rows:
        best[t or ""] = max((i is not None, i or 0, s, t is not None), best.get(t or "", (False, -1, "", False)))
    return sorted(((i if some else None, t if there or t else None, s) for t, (some, i, s, there) in best.items()), key=repr)


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "a", "x"), (1, "b", "x"), (2, "a", "x"), (None, "a", "x"), (None, "c", "x")],
        [(7, "a", "x"), (7, "a", "y"), (7, "a", "y"), (3, "a", "z"), (None, "n", "p"), (None, "n", "q")],
        [(1, "t" * 5000, "x"), (2, "t" * 5000, "y"), (1, "u", "x"), (5, "", "x"), (5, "u", "k")],
    ],
)
def test_drop_copies_with_shared_and_null_ids(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, {"k": 1}) for r in rows], "doc_id long, text string, source string, _n int, _keep int, tags map<string,int>")
    out = X.drop_copies(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=repr) == kept(rows)


def test_keys_beyond_the_bitmap_are_joined(spark, monkeypatch):
    monkeypatch.setattr(X, "MAX_CHUNKS", 0)
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert sorted((tuple(r) for r in X.exact_dedup(df, carry={"text_sha256": lambda t: F.sha2(t, 256)}).collect()), key=repr) == brute(ROWS)


@pytest.mark.parametrize("d", ["sf0.001"])
def test_sql(spark, d):
    compare(spark, f"/root/testdata/{d}", X.op2_exact_dedup, X.OP2_SQL)
