"""Words of whole Arrow batches, hashed with numpy: no Python loop over words or documents.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r; only A-Z are lower-cased. These are
ASCII, so bytes can be looked at one by one in UTF-8. A word's hash is the polynomial
``sum(byte[i] * R**i)`` modulo 2**64 from the word's start, from one running sum over the
batch, then mixed. Two words differ in 64 bits unless they collide, about n**2 / 2**65 for n words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_R = 0x9E3779B97F4A7C15 | 1
#: Text bytes that are hashed at once; a longer document is taken alone.
CHUNK_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, r: int) -> np.ndarray:
    p = np.full(n + 1, r, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POWERS = {r: np.ones(1, np.uint64) for r in (_R, pow(_R, -1, 1 << 64))}


def powers(n: int, r: int) -> np.ndarray:
    if len(_POWERS[r]) <= n:
        _POWERS[r] = _powers(max(n, CHUNK_BYTES + 1), r)
        if n > 4 * CHUNK_BYTES:  # a giant document: don't keep its table
            p, _POWERS[r] = _POWERS[r], _POWERS[r][: CHUNK_BYTES + 2].copy()
            return p[: n + 1]
    return _POWERS[r][: n + 1]


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows with about ``size`` bytes of text."""
    ends = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + size, "right")) - 1)
        yield a, min(b, len(texts))
        a = b


def locate_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, bounds, starts, ends, raw, offsets)``: also where words are in the rows' joined bytes ``raw``.

    Row i has the words ``bounds[i]:bounds[i + 1]`` and the bytes ``offsets[i]:offsets[i + 1]``.
    """
    n = len(texts)
    none = np.empty(0, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    if n:
        offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64, n + 1 + texts.offset)[texts.offset :].astype(np.int64)
    if n == 0 or texts.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64), none, none, np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    size = len(raw)
    inside = ~_SPACE[raw]
    first = np.zeros(size + 1, bool)
    first[offsets] = True
    first = first[:size]
    starts = np.flatnonzero(inside & (first | np.concatenate(([True], ~inside[:-1]))))
    last = np.concatenate((first[1:], [True])) | np.concatenate((~inside[1:], [True]))
    ends = np.flatnonzero(inside & last) + 1
    total = np.zeros(size + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * powers(size, _R)[:size], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * powers(size, pow(_R, -1, 1 << 64))[starts])
    return hashes, np.searchsorted(starts, offsets), starts, ends, raw, offsets


def hash_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)``: words of row i are ``hashes[bounds[i]:bounds[i + 1]]``. Nulls have none."""
    return locate_words(texts)[:2]


def hash_runs(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each run ``hashes[starts[i]:ends[i]]``, equal for equal runs."""
    n = len(hashes)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(n, _R)[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * powers(n, pow(_R, -1, 1 << 64))[starts] + (ends - starts).astype(np.uint64))


def hash_word(word: str) -> int:
    """The hash of one lower-cased word, as ``hash_words`` gives it."""
    return int(hash_words(pa.array([word]))[0][0])


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words of one document; of all its words if it has fewer."""
    k = min(n, len(hashes))
    if k == 0:
        return np.empty(0, np.uint64)
    out = np.full(len(hashes) - k + 1, 0xA5A5A5A5 + k, np.uint64)
    for i in range(k):
        out = mix((out ^ hashes[i : len(hashes) - k + 1 + i]) * np.uint64(_R) + np.uint64(i + 1))
    return out


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct shingles."""
    hashes, bounds = hash_words(texts)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield np.unique(shingles(hashes[a:b], n))
