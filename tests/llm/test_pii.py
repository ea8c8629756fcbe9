import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii as P

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, t):
    d = re.sub("[^0-9]", "", t)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in t.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    out = [(m.start(), o, m.end()) for o, (k, p) in enumerate(BASE) for m in re.finditer(p, text or "") if good(k, m[0])]
    return sorted(out)


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return {r.i: [tuple(x) for x in r.b] for r in df.select("i", P.base_spans(F.coalesce("t", F.lit(""))).alias("b")).collect()}


def test_base_matches_python(spark):
    texts = ["", None, "a@b.c", "x@y.zz_q@w.com", "a@b..c d@e.f.", "..a@b.c-d.e@f.g", "a@b.c@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "01.002.255.0000000255", "256.1.1.1", "1.1.1.1111111111111111111111", "4111 1111 1111 1111", "4111-1111 1111-1111 2", "4111  1111 1111 1111", "+1 (269) 555-3296 4524132264652876", "+1 (269) 555-3296", "++44 20.7946.0958", "é🙂 +12345678901 é a@b.co", "a@b.cd 41111111", "+1((((((", "9" * 30, "5-5-5-5-5-5-5-5-5-5-5-5", "a" * 50_000, "1 " * 30_000, "a.b@c" + ".d" * 20_000, "+1" + " 2" * 9]
    r = random.Random(0)
    texts += ["".join(r.choice(["a", "b1", "@", ".", "-", "_", " ", "4", "11", "+", "(", ")", "255", "é", "\n"]) for _ in range(60)) for _ in range(400)]
    got = spans(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t


def test_planted_data(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = P.op8_pii(spark, d).collect()
    assert len(out) == len(rows)
    for r in out:
        b = brute(rows[r.doc_id])
        listed = ",".join(f"{P.KINDS[o]}:{s}:{e}" for s, o, e in b)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(o == k for _, o, _ in b) for k in range(4)]
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))


def test_bootstrap_finds_unseen(spark):
    docs = [(i, f"word here mailto {chr(97 + i)}x{i}77@host.org and w{i}") for i in range(8)] + [(20, "write mailto user90210x today"), (21, "the user90210x again"), (22, "the page 100200300 of the book")]
    docs += [(30 + i, f"login=me{i}99@host.org ok") for i in range(6)] + [(40, "so login=abc12345 it was"), (50, None), (51, ""), (None, "mailto q555555q")]
    df = spark.createDataFrame([(*x, "s") for x in docs], "doc_id long, text string, base string")
    text = dict(docs)
    found = {r.doc_id: [text[r.doc_id][x.s : x.e] for x in r.found] for r in P.find_pii(df).collect()}
    assert found[20] == ["user90210x"] and found[21] == ["user90210x"] and found[40] == ["abc12345"] and found[None] == ["q555555q"]
    assert all(not v for k, v in found.items() if k not in (20, 21, 40, None))


@pytest.mark.parametrize("rows", [[], [(1, None), (1, None)]])
def test_empty(spark, rows):
    out = P.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and all(r.base == [] and r.found == [] for r in out)


def strip_word(t):
    punct = r"!\"#$%&'()*,\-./:;<=>?@\[\\\]^_`{|}~"
    lead = len(re.match(f"[{punct}]*", t)[0])
    core = re.sub(rf"[{punct}+]+$", "", t[lead:])
    key = (re.match(r"[A-Za-z][A-Za-z0-9_.-]{0,40}[=:]", core) or [""])[0]
    return lead + len(key), core[len(key) :], key.lower()


def found_by_hand(rows):
    """The whole bootstrap over lists: candidates, patterns, scores and rounds."""
    from collections import Counter, defaultdict

    words, cand = Counter(), []
    for n, (_, t) in enumerate(rows):
        t = t or ""
        words.update(t.lower().split())
        spans = brute(t)
        ms = list(re.finditer(r"(?<!\S)[^\s0-9]*[0-9]\S*", t, re.ASCII))
        for k, m in enumerate(ms):
            off, v, key = strip_word(m[0])
            if len(v) < P.MIN_CHARS or len(re.sub("[^0-9]", "", v)) < P.MIN_DIGITS:
                continue
            s, e = m.start() + off, m.start() + off + len(v)
            left = t[ms[k - 1].end() if k else 0 : m.start()].lower().split()
            right = t[m.end() : ms[k + 1].start() if k + 1 < len(ms) else len(t)].lower().split()
            p = ([f"L:|{left[-1]}"] if left else []) + ([f"D:|{left[-2]} {left[-1]}"] if len(left) > 1 else []) + ([f"B:|{left[-1]}|{right[0]}"] if left and right else []) + ([f"K:|{key}"] if key else [])
            cand.append((n, s, e, v.lower(), p, any(a < e and b > s for a, _, b in spans)))
    by = defaultdict(Counter)
    for _, _, _, v, ps, _ in cand:
        for p in ps:
            by[p][v] += 1
    total = {p: max(sum(c.values()), words[p[3:]] if p[0] == "L" else 0) for p, c in by.items()}
    known = {v for _, _, _, v, ps, seed in cand if seed and ps}
    for _ in range(P.ROUNDS):
        good = [p for p, c in by.items() if sum(v in known for v in c) >= P.MIN_VALUES and sum(n for v, n in c.items() if v in known) >= P.MIN_SCORE * total[p]]
        known |= {v for p in good for v in by[p]}
    out = defaultdict(set)
    for n, s, e, v, _, seed in cand:
        if not seed and v in known:
            out[n].add((s, e))
    return [sorted(out[n]) for n in range(len(rows))]


def test_bootstrap_by_brute_force(spark):
    r = random.Random(4)
    word = lambda: r.choice(["alpha", "beta", "Gamma,", "delta", "note", "the", "id:", "user", "ref"])
    thing = lambda: r.choice([f"u{r.randrange(40)}77x9", f"me{r.randrange(30)}9@host.org", f"login=k{r.randrange(20)}1234", f"({r.randrange(90)}4567)", "10.0.0.7", f"+1 555 {r.randrange(100, 130)} 4567", "v2"])
    rows = []
    for i in range(250):
        t = []
        for _ in range(r.randrange(14)):
            mail = r.choice([f"me{r.randrange(300)}9@host.org"] * 3 + [thing()])
            t += r.choice([[word()], [word(), word()], [r.choice(["mailto", "contact me", "write"]), mail, r.choice(["now", "today", word()])], [thing(), thing()]])
        rows.append((i, r.choice([" ", "  ", "\n"]).join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: sorted((y.s, y.e) for y in x.found) for x in P.find_pii(df).collect()}
    want = found_by_hand(rows)
    assert [got[i] for i, _ in rows] == want and sum(map(len, want)) > 30


def test_running_totals(spark):
    r = random.Random(1)
    rows = [[r.randrange(-3, 9) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 9, 10, 99, 100, 101, 1000)]
    df = spark.createDataFrame(list(enumerate(rows)), "i long, a array<int>")
    for x in df.select("i", P.running(F.col("a"), lambda a, b: a + b).alias("s"), P.running(F.col("a"), lambda a, b: F.greatest(a, b)).alias("m")).collect():
        a = rows[x.i]
        assert x.s == [sum(a[: k + 1]) for k in range(len(a))] and x.m == [max([0, *a[: k + 1]]) for k in range(len(a))]


def test_a_megabyte_of_numbers_takes_seconds(spark):
    r = random.Random(2)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(140_000)), " ".join(f"a{i}@b.cc 10.1.2.{i % 300}" for i in range(40_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    out = {x.doc_id: x for x in P.find_pii(df).collect()}
    assert time.time() - began < 90
    for i, t in enumerate(texts):
        assert [(x.s, x.o, x.e) for x in out[i].base] == brute(t)
