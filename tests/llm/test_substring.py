import random
import re

import pytest

from tidemark.llm import substring as S
from tidemark.llm.words import hash_word


M64 = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def units(text, piece, least, line_least):
    """(start, key) of each unit of a text, by plain Python over words; a key tells a line from a passage."""
    lines, pieces = [], []
    at, before = 0, 0
    for line in (text or "").split("\n"):
        words = [(at + m.start(), at + m.end(), m[0].translate(LOW)) for m in re.finditer(r"[^\x20\t-\r]+", line)]
        words = [(a, words[i + 1][0] if i + 1 < len(words) else b, w) for i, (a, b, w) in enumerate(words)]
        at += len(line) + 1
        if len(words) >= max(1, line_least):
            lines.append((words[0][0], words[-1][1], ("line", *(w for _, _, w in words))))
        now = []
        for x in words:
            now.append(x)
            h = hash_word(x[2])
            if mix(mix(before) ^ h) % piece == 0:
                pieces.append(now)
                now = []
            before = h
        if now:
            pieces.append(now)
    passages = []
    for i in range(len(pieces)):
        run = []
        for p in pieces[i:]:
            run += p
            if len(run) >= least:
                passages.append((run[0][0], run[-1][1], ("passage", *(w for _, _, w in run))))
                break
    return sorted(lines + passages, key=lambda u: (u[0], u[2][0] == "line"))


def brute(rows, piece=S.PIECE_WORDS, least=S.MIN_WORDS, line_least=S.MIN_LINE_WORDS):
    """Ids have to be unique: rank by id, nulls last."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first, out = {}, {}
    for i in order:
        u = units(rows[i][1], piece, least, line_least)
        gone = set()
        for k, (a, b, key) in enumerate(u):
            if first.setdefault(key, (i, k)) != (i, k):
                gone.update(range(a, b))
        spans = []
        for c in sorted(gone):
            if spans and spans[-1][1] == c:
                spans[-1][1] = c + 1
            else:
                spans.append([c, c + 1])
        out[rows[i][0]] = (len(u), [tuple(x) for x in spans])
    return out


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 7)))
    passage, line = " ".join(word() for _ in range(70)), " ".join(word() for _ in range(8))
    rows = []
    for i in range(60):
        w = [word() for _ in range(r.randint(0, 120))]
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = [passage]
        t = " ".join(w)
        if i % 4 == 0:
            t = t + "\n" + line + "\n" + word()
        rows.append((i * 13 % 61, t))
    return rows + [(100, rows[5][1]), (101, rows[5][1].upper()), (102, ""), (103, None), (None, rows[7][1])], passage


@pytest.mark.parametrize(("parts", "sizes", "hold"), [(1, (6, 20, 1), 200_000), (5, (6, 20, 5), 300), (3, (3, 8, 4), 50)])
def test_brute_force(spark, monkeypatch, parts, sizes, hold):
    monkeypatch.setattr(S, "HOLD", hold)
    rows, passage = made(parts)
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, run int, data string").repartition(parts)
    got = {r.doc_id: (r.n_units, [(s.start, s.end) for s in r.spans]) for r in S.repeated_spans(df, "doc_id", "text", *sizes).collect()}
    assert got == brute(rows, *sizes)
    assert sum(1 for i, t in rows if passage in (t or "") and any(e - s > 0.6 * len(passage) for s, e in got[i][1])) >= 19


def test_removed_words_stand_in_an_earlier_place(spark):
    """Every removed word is in a whole repeated line, or in 20 words in a row that a document of lower rank has."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = {r.doc_id: r.spans for r in S.op6_substring_dedup(spark, "/root/testdata/sf0.001").collect()}
    seen, lines, removed = set(), set(), 0
    for i, t in sorted(rows):
        words = [(m.start(), m.end(), m[0].translate(LOW)) for m in re.finditer(r"[^\x20\t-\r]+", t or "")]
        own = [w for _, _, w in words]
        ok = [False] * len(words)
        for k in range(len(own) - 19):
            key = tuple(own[k : k + 20])
            if key in seen:
                ok[k : k + 20] = [True] * 20
            seen.add(key)
        at = 0
        for line in (t or "").split("\n"):
            key = tuple(line.translate(LOW).split())
            if key in lines:
                for k, (a, b, _) in enumerate(words):
                    ok[k] |= at <= a and b <= at + len(line)
            lines.add(key)
            at += len(line) + 1
        for span in filter(None, found[i].split(",")):
            a, b = map(int, span.split(":"))
            inside = [k for k, (s, e, _) in enumerate(words) if s >= a and e <= b]
            removed += len(inside)
            assert all(ok[k] for k in inside)
    assert removed > 100


def test_clean_documents_stay(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(100))) for i in range(9)], "doc_id long, text string")
    assert all(r.spans == [] for r in S.repeated_spans(df).collect())


def without(t, spans):
    keep = [True] * len(t or "")
    for a, b in spans:
        keep[a:b] = [False] * (b - a)
    return None if t is None else "".join(c for c, k in zip(t, keep, strict=True) if k)


def test_cut_text(spark):
    rows, _ = made(3)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, spans string, row int")
    out = S.remove_repeats(df)
    want = {i: without(dict(rows)[i], s) for i, (_, s) in brute(rows).items()}
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()} == want


def test_cut_text_with_shared_and_null_ids(spark):
    text = " ".join(f"v{j}" for j in range(60))
    rows = [(1, text), (1, "one of its own"), (None, text), (None, "another of its own"), (2, None)]
    out = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted([(1, text), (1, "one of its own"), (None, ""), (None, "another of its own"), (2, None)], key=repr)


def test_long_text(spark):
    body = " ".join(f"w{j * 7919 % 100_003}" for j in range(90_000))
    rows = [(1, body), (2, "before it " + body), (3, "x" * 300_000)]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in S.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[3] == [] and len(got[2]) == 1 and got[2][0][1] == len(rows[1][1]) and got[2][0][0] < 200


def test_empty_and_repeated_rows(spark):
    assert S.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(f"v{j}" for j in range(60))
    out = S.repeated_spans(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert sorted(len(r.spans) for r in out) == [0, 1]
