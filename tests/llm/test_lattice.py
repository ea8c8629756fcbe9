import numpy as np
import pytest
from test_oracle import compare

from tidemark.llm import lattice as L


def brute(rows, cosine=0.98):
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) and lab is not None for _, v, lab in rows]
    n = len(rows)
    up, deg = list(range(n)), [0] * n

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    up[root(a)] = root(b)
                    deg[a] += 1
                    deg[b] += 1
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, deg[i], least.get(root(i)), d == least.get(root(i))) for i, (d, _, _) in enumerate(rows)), key=repr)


def got(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, node int, t string")
    return sorted((tuple(r) for r in L.near_vectors(df).collect()), key=repr)


def made(seed, n=240, dim=64, spread=0.14):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 12 == 0:
            c = r.normal(size=dim)
            c /= np.linalg.norm(c)
        g = r.normal(size=dim)
        v = c + spread * r.uniform(0, 1.4) * g / np.linalg.norm(g)
        rows.append((int(i * 7 % 1013), v.astype(np.float32).tolist(), int(i // 12 % 3)))
    return rows


@pytest.mark.parametrize("block", [512, 4])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    rows = made(1)
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, None], 1), (8, [], 1), (9, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (10, [1e-30, 0.0], 1), (11, [3e38, 1e30], 1), (12, [-1.0, 0.0], 1), (13, [float("inf"), 0.0], 1), (14, [1.0, 0.0], 2)]
    rows = [(a, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for a, v, lab in rows]
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert L.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_decoder_is_nearest():
    assert len(np.unique(L.ROOTS, axis=0)) == 240 and np.allclose((L.ROOTS**2).sum(axis=1), 2)
    x = np.random.default_rng(0).normal(scale=3, size=(500, 8))
    p = L.decode(x)
    assert (((x - p) ** 2).sum(axis=1)[:, None] <= ((x[:, None] - p[:, None] - L.ROOTS) ** 2).sum(axis=2) + 1e-12).all()
    assert (((2 * p).astype(int) % 2).sum(axis=1) % 8 == 0).all() and (p.sum(axis=1) % 2 == 0).all()


def test_recall_at_the_threshold():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = r.normal(size=x.shape)
    g -= (g * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    (hx, px), (hy, py) = L.cells(x), L.cells(y)
    assert ((hx == hy) | (px == hy[:, :, None]).any(axis=2) | (py == hx[:, :, None]).any(axis=2)).any(axis=1).mean() > 0.999


def test_sql(spark):
    compare(spark, "/root/testdata/sf0.001", L.op1_lattice_dedup, L.OP1_SQL)
