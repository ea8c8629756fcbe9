import numpy as np
import zstandard as zstd
from pyspark.sql import functions as F

from tidemark.llm import toxicity as X
from tidemark.llm.langid import fold


def test_held_out(spark):
    """About 300 toxic documents to learn from: over a third of the others are found, next to no ordinary one."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = X.op7_toxicity(spark, d).where("held_out").join(labels, "doc_id").toPandas()
    assert len(out) > 500 and out.score.between(0, 1).all()
    assert (out.predicted[out.toxic == 1] == 1).mean() > 0.35
    assert (out.predicted[out.toxic == 0] == 1).mean() < 0.03


def length(content, window):
    """Under a dictionary that is loaded for this one window."""
    p = zstd.ZstdCompressionParameters.from_level(X.LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS, window_log=23)
    twice = lambda x: bytes(v for b in x for v in (b, (3 * b + 37) % 256))
    d = zstd.ZstdCompressionDict(twice(content), dict_type=zstd.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return len(zstd.ZstdCompressor(dict_data=d, compression_params=p).compress(twice(window)))


def cut(text):
    w = text.lower().encode().split()
    out, at = [], 0
    while w and (at == 0 or at + X.WORDS - X.STRIDE < len(w)):
        out.append(b" " + b" ".join(w[at : at + X.WORDS]) + b" ")
        at += X.STRIDE
    return out


def made(r, bad, n):
    return [" ".join(r.choice(["plain", "house", "water", "often", "green", *bad]) + str(r.integers(300)) for _ in range(n)) for _ in range(40)]


def test_distances_by_brute_force():
    r = np.random.default_rng(3)
    ordinary, toxic = made(r, [], 90), made(r, ["gromblex"], 90)
    mine, base = X.dictionaries([w for t in toxic for w in X.windows(t)], [w for t in ordinary for w in X.windows(t)])
    d = X.Distance(mine, base)
    runs = lambda x: {x[i : i + X.PIECE] for i in range(len(x) - X.PIECE + 1)}
    own = runs(mine) - runs(base)
    for t in (toxic[0], ordinary[0], "one", "a " * 70, "Gromblex12 PLAIN3 " * 20, ""):
        assert X.windows(t) == cut(t)
        both = [(length(base, w), length(mine + base, w) if runs(w) & own else None) for w in cut(t)]
        both = [(a, a if b is None else b) for a, b in both]
        far = sorted((max(0, (a - b) / a) for a, b in both), reverse=True) + [0.0, 0.0]
        gain = [max(0, a - b - 1) for a, b in both] or [0]
        assert np.allclose(d.features(t), [far[0], far[1], sum(far) / max(1, len(both)), np.log1p(max(gain)), np.log1p(sum(gain))])
    assert d.features(toxic[0])[0] > 0


def test_windows_hold_every_word():
    w = [f"w{i}" for i in range(1000)]
    for n in (1, 28, 31, 32, 33, 60, 61, 1000):
        assert {x for y in X.windows(" ".join(w[:n])) for x in y.decode().split()} == set(w[:n])
    long = "x" * 100_000 + " y"
    assert b"".join(X.windows(long)) == b" " + long.encode() + b" " and max(map(len, X.windows(long))) <= X.MAX_WINDOW
    assert X.windows(None) == X.windows(" \n") == []


def test_dictionaries_do_not_depend_on_the_order():
    r = np.random.default_rng(5)
    a, b = ([w for t in made(r, bad, 60) for w in X.windows(t)] for bad in (["gromblex"], []))
    assert X.dictionaries(a, b) == X.dictionaries(a[::-1], b[::-1])


def test_toxic_windows_are_nearer():
    r = np.random.default_rng(7)
    a, b = ([w for t in made(r, bad, 90) for w in X.windows(t)] for bad in (["gromblex", "plixtor"], []))
    d = X.Distance(*X.dictionaries(a, b))
    assert d.saved(b" plain1 house2 gromblex77 often4 ") > 1 >= d.saved(b" plain1 house2 water77 often4 ")


def test_calibrate_separates():
    x = np.r_[np.random.default_rng(0).normal(0, 1, (200, 2)), np.random.default_rng(1).normal(4, 1, (200, 2))]
    w = X.calibrate(x, np.r_[np.zeros(200), np.ones(200)])
    p = np.column_stack((x, np.ones(400))) @ w > 0
    assert (p == np.r_[np.zeros(200), np.ones(200)]).mean() > 0.97


def test_cut_by_brute_force():
    r = np.random.default_rng(2)
    for _ in range(20):
        y = (r.random(30) < 0.4).astype(float)
        z, w = np.round(r.normal(0, 1, 30) + y, 1), r.integers(1, 4, 30).astype(float)
        f1 = lambda c: 1.25 * w[(z >= c) & (y == 1)].sum() / (0.25 * w[y == 1].sum() + w[z >= c].sum())  # noqa: B023, E731
        assert np.isclose(f1(X.cut_at(z, y, w)), max(map(f1, z)))


def test_odd_rows(spark):
    text = lambda i, w: " ".join(f"{x}{i * k % 37}" for k, x in enumerate(["house", "water", w, "often", "green", w]))
    rows = [(i, text(i, "gromblex" if i % 2 else "table"), "x") for i in range(400)] + [(None, "gromblex", None), (500, None, "y"), (501, "", "y"), (1, text(1, "gromblex"), "x"), (502, "x" * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (3, None), (5, 1)], "doc_id long, toxic int")
    out = X.score_toxicity(df, labels, F.lit(True), keep=("doc_id",)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r.predicted for r in out}
    assert sum(got[i] == i % 2 for i in range(400)) > 380 and got[500] == got[501] == got[502] == 0
    one = X.score_toxicity(df, labels.where("toxic = 1"), F.lit(True), keep=("doc_id",))
    assert {r.score for r in one.collect()} == {0.0}
    assert X.score_toxicity(df.limit(0), labels, fold(F.col("doc_id"), 3) != 1, keep=("doc_id",)).count() == 0
