import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import runs
from tidemark.llm import words as W

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXT = st.text(alphabet="aAbÉé日 \t\n\x0b\x0c\r\x1c\xa0🙂", max_size=40)


def split(t):
    return re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(0, 3))
def test_words_and_places(texts, skip):
    a = pa.array(texts, pa.string()).slice(skip)
    texts = texts[skip:]
    h, bounds, starts, ends, raw, offsets = W.locate_words(a)
    for i, t in enumerate(texts):
        want = split(t)
        assert [W.hash_word(w) for w in want] == h[bounds[i] : bounds[i + 1]].tolist()
        got = [bytes(raw[s:e]).decode().translate(LOW) for s, e in zip(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]], strict=True)]
        assert got == want


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_giant_and_tiny(kind, monkeypatch):
    monkeypatch.setattr(W, "CHUNK_BYTES", 100)
    texts = ["", "a b " * 500, "x", None, "y z"]
    a = pa.array(texts, kind)
    seen = [(x, y) for x, y in W.chunks(a, 100)]
    assert seen[0][0] == 0 and seen[-1][1] == 5 and all(p[1] == q[0] for p, q in zip(seen, seen[1:], strict=False))
    h, b = W.hash_words(a)
    assert np.diff(b).tolist() == [0, 1000, 1, 0, 2] and len(set(h[:1000].tolist())) == 2


@given(st.lists(st.sampled_from("abc"), max_size=12), st.integers(1, 5))
def test_shingles(w, n):
    h = np.array([W.hash_word(x) for x in w], np.uint64)
    want = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([tuple(w)] if w else [])
    got = W.shingles(h, n).tolist()
    assert len(got) == len(want) and len(set(got)) == len(set(want))


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2)), max_size=40), st.integers(1, 7))
def test_whole_runs(keys, size):
    keys = sorted(keys)
    batches = [pa.RecordBatch.from_pydict({"a": pa.array([k for k, _ in part], pa.int64()), "b": pa.array([k for _, k in part], pa.int64())}) for i in range(0, len(keys), size) if (part := keys[i : i + size])]
    got = []
    for t, bounds in runs.whole_runs(iter(batches), "a", "b"):
        rows = list(zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True))
        got += [rows[p:q] for p, q in zip(bounds[:-1], bounds[1:], strict=True)]
    assert [r for g in got for r in g] == keys
    assert len(got) == len(set(keys)) and all(len(set(g)) == 1 for g in got)
