import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from test_oracle import compare

from tidemark.llm import mixing as M


def usable(node, weights, epochs, depth=0):
    """Tokens that a node can use: a leaf's epochs; nothing below a weight of 0. Bottom-up, by recursion."""
    if depth == len(M.LEVELS):
        return node * epochs
    return sum(usable(v, weights, epochs, depth + 1) for k, v in node.items() if weights.get(M.LEVELS[depth], {}).get(k, 1) > 0)


def hand_down(node, total, weights, epochs, path=()):
    """Budget of each leaf. Rounds: whoever's share covers what they can use is filled; then largest remainders."""
    if len(path) == len(M.LEVELS):
        return {path: total}
    w = {k: weights.get(M.LEVELS[len(path)], {}).get(k, 1) for k in node}
    can = {k: usable(v, weights, epochs, len(path) + 1) for k, v in node.items()}
    got, open_ = {}, {k for k in node if w[k] > 0}
    while True:
        left, all_w = total - sum(got.values()), sum(w[k] for k in open_)
        filled = {k for k in open_ if can[k] <= Fraction(left * w[k], all_w)}
        got |= {k: can[k] for k in filled}
        open_ -= filled
        if not filled:
            break
    share = {k: Fraction(left * w[k], all_w) for k in open_}
    got |= {k: int(x) for k, x in share.items()}
    spare = left - sum(int(x) for x in share.values())
    for k in sorted(open_, key=lambda k: (-(share[k] - int(share[k])) * all_w, k))[:spare]:
        got[k] += 1
    out = {}
    for k, b in got.items():
        out |= hand_down(node[k], b, weights, epochs, (*path, k))
    return out


def brute(rows, weights, percent, epochs, seed):
    docs = [(i, M.DOMAINS[int((re.search("([0-9]{1,9})$", s or "") or [0, 0])[1]) % 3], lang or M.NONE, s or M.NONE, len(re.findall("[^\x20\t-\r]+", t or ""))) for i, t, lang, s in rows]
    leaves, tree = defaultdict(int), {}
    for d in docs:
        leaves[d[1:4]] += d[4]
    for (a, b, c), n in leaves.items():
        tree.setdefault(a, {}).setdefault(b, {})[c] = n
    level = hand_down(tree, sum(leaves.values()) * percent // 100, weights, epochs)
    out = []
    for leaf, n in leaves.items():
        b = level.get(leaf)
        if b is None:
            continue
        q = b // n if n else 0
        rest, own = b - q * n, [d for d in docs if d[1:4] == leaf]
        key = lambda d: hashlib.md5(f"{seed}|{q}|{'' if d[0] is None else d[0]}".encode()).hexdigest()  # noqa: B023, E731
        for d in own:
            upto = sum(x[4] for x in own if key(x) <= key(d))
            if q + (upto <= rest):
                out.append((*d, q + (upto <= rest)))
    return sorted(out, key=repr)


def made():
    rows = [(i, "w " * (i * 7 % 23), ["en", "de", None][i % 3], f"s{i % 7}" if i % 11 else None) for i in range(200)]
    return rows + [(5, "w w", "en", "s1"), (5, "w w", "en", "s1"), (None, "a b c", "en", "s2"), (None, None, "de", "s3"), (300, "", "xx", "only"), (301, "q " * 4000, "en", "s4")]


@pytest.mark.parametrize(("weights", "percent", "epochs"), [(M.WEIGHTS, 60, 2), ({"domain": {"web": 90}, "source": {"s1": 0}}, 80, 1), ({}, 250, 3), ({}, 0, 1), ({"domain": {"web": 0, "books": 3}, "lang": {"en": 7, "de": 0}, "source": {"s2": 0, "s5": 11}}, 70, 1)])
def test_brute_force(spark, weights, percent, epochs):
    df = spark.createDataFrame([(*r, 1, "k") for r in made()], "doc_id long, text string, lang string, source string, tokens int, key string")
    out = M.mix(df, weights=weights, share_percent=percent, max_epochs=epochs)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(made(), weights, percent, epochs, M.SEED)


def test_shortage_of_a_family_with_a_zero_weight_goes_to_its_siblings(spark):
    """web can use 10 tokens, as a3 weighs nothing; books take the rest of 255."""
    leaves = [("web", "en", "a3", 100), ("web", "en", "b3", 10), ("books", "en", "c1", 400)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long").withColumn("capacity", F.col("tokens"))
    weights = {"source": {"a3": 0}, "domain": {"web": 1, "books": 1}}
    out = {r.source: r.budget for r in M.budgets(df, F.lit(255).cast("decimal(38,0)"), weights).collect()}
    assert out.get("a3", 0) == 0 and out["b3"] == 10 and out["c1"] == 245


def test_no_token_is_left_over(spark):
    leaves = [("web", "en", f"s{i}", 100) for i in range(7)] + [("books", x, f"t{i}", 50) for x in ("en", "de", "fr") for i in range(3)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long").withColumn("capacity", F.col("tokens"))
    for total in (1, 2, 3, 100, 101, 997, 1149, 5000):
        out = M.budgets(df, F.lit(total).cast("decimal(38,0)"), M.WEIGHTS).agg(F.sum("budget")).first()[0]
        assert out == min(total, 1150)


def test_weights_are_whole_numbers(spark):
    df = spark.createDataFrame([(1, "a", "en", "s1")], "doc_id long, text string, lang string, source string")
    for w in (0.5, -1):
        with pytest.raises(ValueError, match="whole number"):
            M.mix(df, weights={"lang": {"en": w}})


def test_take_mix(spark):
    df = spark.createDataFrame([r for r in made() if r[0] != 5], "doc_id long, text string, lang string, source string")
    want = M.mix(df).agg(F.sum("copies")).first()[0]
    out = M.take_mix(df)
    assert out.count() == want and out.columns == df.columns


def test_empty(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_sql(spark):
    compare(spark, "/root/testdata/sf0.001", M.op3_mixing, M.OP3_SQL)
