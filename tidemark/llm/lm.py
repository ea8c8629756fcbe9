"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and of n-grams up to ``order`` words are gathered over all training documents. They travel as
packed arrays, dealt into buckets by a hash of the whole n-gram, so a frequent word or history is spread
over all of them. An n-gram's count is quantised to u, the power of two at or below it; the filter gets
one key for each doubling, and u is read back by asking for the first, second, third ... key until one is missing.
For each history h the filter also holds U(h), the sum of u over what follows h: one key for each binary
digit of its length and one for each digit that is 1. With p1 for single words,

    p1(w)    = (u(w) + ALPHA) / (U1 + ALPHA * (V + 1))
    p(w | h) = (u(h w) + R(h) * p(w | shorter h)) / (U(h) + R(h))
    R(h)     = BACKOFF + max(0, u(h) - U(h))

which sums to 1 over the V words and the unknown one, whatever R is, because U(h) is the sum of the very
numbers that are read. N-grams of two words and more take part from ``min_count`` occurrences on, at any size
of the corpus. (By then u(h) is at least about U(h); what it has more is followed by something rarer.)

The filter has BITS_A_KEY bits for each key that was counted. It is broadcast; up to MAX_BITS it grows
with the corpus, beyond that keys get fewer bits each: no n-gram is left out, but more are taken
for others that occur. A key's part of the filter (of PARTS) is built in one task.

The exact unigram score beside it uses exact counts. Common words (at most ``HEAD_WORDS``, the most frequent)
are broadcast; every other word of a document is sent to its bucket, where its count is, and
the sums come back by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import bounded_batches
from tidemark.llm.langid import fold
from tidemark.llm.words import chunks, hash_words, mix
from tidemark.storage import durable, release

#: Longest n-gram, and occurrences from which an n-gram of two words and more is in the model.
ORDER, MIN_COUNT = 3, 2
#: Weight of the shorter history, in occurrences.
BACKOFF = 1.0
ALPHA = 0.1
#: Parts of the filter; bits of a key in each of the two words that it is in; bits of the filter for a key;
#: fewest and most bits of the filter (8 MB, 256 MB).
PARTS, PROBES, BITS_A_KEY, MIN_BITS, MAX_BITS = 64, 4, 12, 1 << 26, 1 << 31
#: Exact counts of at most so many words are broadcast.
HEAD_WORDS = 1 << 17
#: N-grams that a task holds before it counts and hands them on.
HOLD = 3_000_000

START, END = np.uint64(0x5354415254000001), np.uint64(0x454E440000000001)
#: Bits of an n-gram's key that are the last word's; the others are its history's.
WORD_BITS = np.uint64(24)
_LENGTH, _DIGIT = np.uint64(0x4444), np.uint64(0x5555)
_ODD = np.uint64(0x9E3779B97F4A7C15)
PACKED = "bucket int, kind int, keys binary, counts binary"
LEVELS = 64


def level(c: np.ndarray) -> np.ndarray:
    """1 for a count of 1, and one more each time it doubles; 0 for 0."""
    return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0).astype(np.int64)


def value(q: np.ndarray) -> np.ndarray:
    """u: the smallest count that has this level."""
    return np.where(q > 0, 2.0 ** (q - 1), 0.0)


def tokens_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(tokens, bounds)``: each row's word hashes and END."""
    h, b = hash_words(text)
    n = np.diff(b)
    bounds = np.concatenate(([0], np.cumsum(n + 1)))
    tokens = np.full(bounds[-1], END, np.uint64)
    tokens[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return tokens, bounds


def histories(tokens: np.ndarray, bounds: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 2 to ``order``: places of the tokens that end an n-gram, and the hash of the n - 1 tokens before each.

    A text begins with one START; n-grams that would begin before it don't exist.
    """
    place = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
    run = tokens  # hash of the last n - 1 tokens, the one at the place included
    for n in range(2, order + 1):
        before = np.empty_like(run)
        before[1:] = run[:-1]
        if n == 2:
            before[bounds[:-1]] = START
        at = np.flatnonzero(place >= n - 2)
        # The hash of the text's first n - 2 tokens and START.
        yield at, mix(before[at] ^ np.uint64(n))
        run = mix(before * _ODD + tokens)


def gram_key(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """40 bits of the history and 24 of the last word; what they lack is in the bucket."""
    return (history >> WORD_BITS << WORD_BITS) | (mix(word) >> (np.uint64(64) - WORD_BITS))


def gram_bucket(history: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    """One of ``buckets``, a power of two."""
    return mix(history * _ODD + word) & np.uint64(buckets - 1)


def _transposed(x: np.ndarray) -> bytes:
    """Sorted numbers byte by byte: the leading ones compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _restored(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    k = keys[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(counts[order], first) if len(k) else counts


def _split(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket.astype(np.uint16 if n <= 1 << 16 else np.uint32), kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def _counted(parts: list[tuple[np.ndarray, np.ndarray]], kind: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of each bucket: keys that occur once without, others with their counts."""
    if not parts:
        return
    bucket, keys = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, at = _split(bucket, buckets)
    keys = keys[order]
    for i in np.flatnonzero(np.diff(at)).tolist():
        own = np.sort(keys[at[i] : at[i + 1]])
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        n = np.diff(np.concatenate((first, [len(own)])))
        own, one = own[first], n == 1
        yield _packed(i, kind, _transposed(own[one]), b"")
        yield _packed(i, kind, _transposed(own[~one]), n[~one].astype("<u4").tobytes())


def _packed(bucket: int, kind: int, keys: bytes, counts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([keys], pa.binary()), pa.array([counts], pa.binary())], ["bucket", "kind", "keys", "counts"])


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, bytes]]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "keys", "counts")), strict=True)


def gather(train: DataFrame, buckets: int, order: int = ORDER, min_count: int = MIN_COUNT) -> DataFrame:
    """Kind 1: words and counts; kind 2: n-grams that are in the model, with levels; kind 3 (its bucket is a part of the
    filter): histories, and what u of those n-grams in one bucket adds to U."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, gram, held = [], [], 0
        for b in batches:
            for x, y in chunks(b.column(0)):
                t, bounds = tokens_of(b.column(0).slice(x, y - x))
                word.append((t & np.uint64(buckets - 1), t))
                held += len(t)
                for at, h in histories(t, bounds, order):
                    gram.append((gram_bucket(h, t[at], buckets), gram_key(h, t[at])))
                    held += len(at)
                if held > HOLD:
                    yield from _counted(word, 1, buckets)
                    yield from _counted(gram, 2, buckets)
                    word, gram, held = [], [], 0
        yield from _counted(word, 1, buckets)
        yield from _counted(gram, 2, buckets)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for bucket, kind, keys, counts in _rows_of(batches):
            k = _restored(keys)
            held.setdefault((bucket, kind), []).append((k, np.frombuffer(counts, "<u4").astype(np.int64) if counts else np.ones(len(k), np.int64)))
        for bucket, kind in sorted(held):
            k, c = _summed(*(np.concatenate(x) for x in zip(*held.pop((bucket, kind)), strict=True)))
            if kind == 1:
                yield _packed(bucket, 1, k.astype("<u8").tobytes(), c.astype("<i8").tobytes())
                continue
            k, q = k[c >= min_count], level(c[c >= min_count])
            yield _packed(bucket, 2, k.astype("<u8").tobytes(), q.astype("<i8").tobytes())
            h, u = _summed(k >> WORD_BITS, value(q).astype(np.int64))
            to, at = _split(h % np.uint64(PARTS), PARTS)
            for p in np.flatnonzero(np.diff(at)).tolist():
                own = to[at[p] : at[p + 1]]
                yield _packed(p, 3, h[own].astype("<u8").tobytes(), u[own].astype("<i8").tobytes())

    return train.mapInArrow(count, PACKED).repartition(buckets, "bucket").mapInArrow(merge, PACKED)


def summary(counts: DataFrame) -> tuple[int, int, int, int, np.ndarray]:
    """Tokens, distinct tokens, their U1, keys of the filter (U's at most), and how many words have each level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kind, _, raw in _rows_of(batches):
            c = np.frombuffer(raw, "<i8")
            q = c if kind == 2 else level(c)
            h = np.bincount(q, minlength=LEVELS)
            n = len(h)
            # A sum has one key for each digit and at most one more, and half of these are 0.
            keys = int(q.sum()) if kind != 3 else int(1.5 * q.sum())
            yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(h, pa.int64()), pa.array([int(c.sum())] + [0] * (n - 1), pa.int64()), pa.array([keys] + [0] * (n - 1), pa.int64())], ["kind", "q", "n", "total", "keys"])

    rows = counts.select("bucket", "kind", F.lit(b"").alias("keys"), "counts").mapInArrow(run, "kind int, q int, n long, total long, keys long")
    by = np.zeros(LEVELS, np.int64)
    total = keys = 0
    for r in rows.groupBy("kind", "q").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("keys").alias("keys")).collect():
        keys += r["keys"]
        if r.kind == 1:
            by[r.q] += r.n
            total += r.total
    u = int((by[1:] * 2 ** np.arange(LEVELS - 1, dtype=object)).sum())
    return total, int(by[1:].sum()), u, keys, by


def filter_bits(keys: int) -> int:
    """Bits of each of the PARTS parts: whole 64-bit words."""
    return int(min(MAX_BITS, max(MIN_BITS, keys * BITS_A_KEY)) // PARTS // 64 * 64)


def _probe(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of a word inside a part of ``words`` words, and the bits of a key with this hash in it."""
    mask = np.zeros(len(h), np.uint64)
    for i in range(PROBES):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return (h >> np.uint64(32)) * np.uint64(words) >> np.uint64(32), mask


def _second(h: np.ndarray) -> np.ndarray:
    """The hash for the other word."""
    return mix(h + _ODD)


def _nth(key: np.ndarray, j: int, tag: np.uint64 = np.uint64(0)) -> np.ndarray:
    """Hash of the key's ``j``-th key of a sort."""
    return mix((key ^ tag) + np.uint64(j) * _ODD)


# Keys as they are told apart; ``_nth`` mixes them.


def _word_key(word: np.ndarray) -> np.ndarray:
    return word ^ np.uint64(0x1111 << 40)


def _bucket_keys(buckets: int) -> np.ndarray:
    """What a bucket adds to the keys of its n-grams."""
    return mix(np.arange(buckets, dtype=np.uint64) ^ np.uint64(0x2222 << 40))


def _history_key(history: np.ndarray) -> np.ndarray:
    """Of its 40 bits."""
    return mix(history ^ np.uint64(0x3333 << 48))


def build_filter(counts: DataFrame, size: int, buckets: int) -> np.ndarray:
    """The filter's bits. Each part is made in one task and sent to the driver: PARTS * size bits in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        sums: dict[int, list] = {}
        of_bucket = _bucket_keys(buckets)

        def put(bits: np.ndarray, key: np.ndarray) -> None:
            for h in (key, _second(key)) if len(key) else ():
                at, mask = _probe(h, size // 64)
                order = np.argsort(at)
                at, mask = at[order].astype(np.int64), mask[order]
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                bits[at[first]] |= np.bitwise_or.reduceat(mask, first)

        for bucket, kind, keys, raw in _rows_of(batches):
            k, c = np.frombuffer(keys, "<u8"), np.frombuffer(raw, "<i8")
            bits = parts.setdefault(bucket % PARTS, np.zeros(size // 64, np.uint64))
            if kind == 3:
                sums.setdefault(bucket, []).append((k, c))
                continue
            key, q = (_word_key(k), level(c)) if kind == 1 else (k ^ of_bucket[bucket], c)
            for j in range(1, int(q.max(initial=0)) + 1):
                put(bits, _nth(key[q >= j], j))
        for part, lists in sums.items():
            k, u = _summed(*(np.concatenate(x) for x in zip(*lists, strict=True)))
            key, length = _history_key(k), level(u)
            for j in range(1, int(length.max(initial=0)) + 1):
                put(parts[part], _nth(key[length >= j], j, _LENGTH))
                put(parts[part], _nth(key[(length > j) & (u >> (j - 1) & 1 == 1)], j, _DIGIT))
        for p, bits in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["part", "bits"])

    out = np.zeros(PARTS * size // 64, np.uint64)
    rows = counts.withColumn("_part", F.col("bucket") % PARTS).repartition(PARTS, "_part").drop("_part").mapInArrow(run, "part int, bits binary")
    for r in rows.toLocalIterator():
        out[r.part * size // 64 : (r.part + 1) * size // 64] |= np.frombuffer(bytes(r.bits), np.uint64)
    return out


class Model:
    """What is broadcast: the filter, the head of the exact counts, and the totals."""

    def __init__(self, bits: np.ndarray, size: int, head: tuple[np.ndarray, np.ndarray], tokens: int, kinds: int, units: int, texts: int, buckets: int, order: int) -> None:
        self.bits, self.size, self.head, self.tokens, self.kinds, self.units, self.texts, self.buckets, self.order = bits, size, head, tokens, kinds, units, texts, buckets, order
        self.of_bucket = _bucket_keys(buckets)

    def has(self, part: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Places of the keys with these hashes that are members: all bits are set in both words."""
        words = self.size // 64
        base = part * np.uint64(words)
        at, mask = _probe(h, words)
        some = np.flatnonzero(self.bits[(base + at).astype(np.int64)] & mask == mask)
        at, mask = _probe(_second(h[some]), words)
        return some[self.bits[(base[some] + at).astype(np.int64)] & mask == mask]

    def levels(self, part: np.ndarray, key: np.ndarray, tag: np.uint64 = np.uint64(0)) -> np.ndarray:
        """Level of each key: membership probes until one fails."""
        q = np.zeros(len(key), np.int64)
        alive, j = np.arange(len(key)), 1
        while len(alive) and j < LEVELS:
            good = self.has(part, _nth(key, j, tag))
            alive, part, key = alive[good], part[good], key[good]
            q[alive] = j
            j += 1
        return q

    def words(self, word: np.ndarray) -> np.ndarray:
        """u of each word."""
        some, at = np.unique(word, return_inverse=True)
        return value(self.levels(some & np.uint64(PARTS - 1), _word_key(some)))[at]

    def grams(self, history: np.ndarray, word: np.ndarray) -> np.ndarray:
        """u of each n-gram."""
        bucket = gram_bucket(history, word, self.buckets)
        return value(self.levels(bucket & np.uint64(PARTS - 1), gram_key(history, word) ^ self.of_bucket[bucket.astype(np.int64)]))

    def sums(self, history: np.ndarray) -> np.ndarray:
        """U of each history."""
        some, at = np.unique(history >> WORD_BITS, return_inverse=True)
        part, key = some & np.uint64(PARTS - 1), _history_key(some)
        length = self.levels(part, key, _LENGTH)
        out = value(length)
        for j in range(1, int(length.max(initial=0))):
            more = np.flatnonzero(length > j)
            out[more[self.has(part[more], _nth(key[more], j, _DIGIT))]] += 2.0 ** (j - 1)
        return out[at]

    def log_probabilities(self, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 p(token | the order - 1 tokens before it)."""
        shorter = self.words(tokens)  # u of the n-gram of one word less that ends here
        p = (shorter + ALPHA) / (self.units + ALPHA * (self.kinds + 1))
        for n, (at, h) in enumerate(histories(tokens, bounds, self.order), 2):
            # u of the history itself: the shorter n-gram that ends one place before.
            own = np.empty(len(tokens))
            own[1:] = shorter[:-1]
            if n == 2:
                own[bounds[:-1]] = value(level(np.array([self.texts])))[0]
            own, u = own[at], np.zeros(len(at))
            # An n-gram can't be in the model unless both shorter ones are.
            some = np.flatnonzero((own > 0) & (shorter[at] > 0))
            u[some] = self.grams(h[some], tokens[at[some]])
            follow = np.zeros(len(at))
            some = np.flatnonzero(own > 0)
            follow[some] = self.sums(h[some])
            rest = BACKOFF + np.maximum(0, own - follow)
            p[at] = np.where(follow > 0, (u + rest * p[at]) / (follow + rest), p[at])
            shorter = np.zeros(len(tokens))
            shorter[at] = u
        return np.log10(p)


def head_words(counts: DataFrame, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words and their counts, sorted by key, at most HEAD_WORDS."""
    q, room = LEVELS, HEAD_WORDS
    while q > 1 and by[q - 1] <= room:
        q -= 1
        room -= by[q]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, keys, raw in _rows_of(batches):
            k, c = np.frombuffer(keys, "<u8"), np.frombuffer(raw, "<i8")
            keep = level(c) >= q
            yield _packed(0, 1, k[keep].tobytes(), c[keep].tobytes())

    rows = counts.where("kind = 1").mapInArrow(run, PACKED).select("keys", "counts").collect()
    k = np.frombuffer(b"".join(bytes(r["keys"]) for r in rows), "<u8")
    c = np.frombuffer(b"".join(bytes(r["counts"]) for r in rows), "<i8")
    order = np.argsort(k)
    return k[order], c[order]


def score_text(
    docs: DataFrame,
    train_rows: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    order: int = ORDER,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """One row for each input row: ``keep``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    The model learns from rows where ``train_rows`` is true (null: no). A null text counts as
    empty; it has one token, the end; the longest text is one run of tokens, whole. Repeated rows are trained on, and scored, one by one. If
    nothing could be learned, counts and totals are 0 and every token has the same probability.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A bucket holds about what one shuffle partition does.
    buckets = max(PARTS, 1 << (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    trained = docs.where(train_rows).select(text)
    counts = durable(gather(trained, buckets, order, min_count))
    n, v, units, keys, by = summary(counts)
    size = filter_bits(keys)
    model = Model(build_filter(counts, size, buckets), size, head_words(counts, by), n, v, units, trained.count(), buckets, order)
    shared = spark.sparkContext.broadcast(model)
    del model
    kinds = dict(docs.dtypes)
    named = [f"_k{i}" for i in range(len(keep))]
    fields = [f"{a} {kinds[c]}" for a, c in zip(named, keep, strict=True)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of kind 0 are documents; kind 3 carries the rarer words of a run of documents to a bucket."""
        m: Model = shared.value
        head, head_counts = m.head
        run_id = TaskContext.get().partitionId() << 32
        for b in batches:
            for x, y in chunks(b.column("_text")):
                part = b.slice(x, y - x)
                t, bounds = tokens_of(part.column("_text"))
                doc = np.repeat(np.arange(y - x), np.diff(bounds))
                at = np.minimum(np.searchsorted(head, t), max(0, len(head) - 1))
                common = head[at] == t if len(head) else np.zeros(len(t), bool)
                logs = np.log10(head_counts + ALPHA)
                base = np.bincount(doc[common], logs[at[common]] if len(head) else None, y - x)
                known = np.bincount(doc[common], minlength=y - x)
                score = np.add.reduceat(m.log_probabilities(t, bounds), bounds[:-1])
                yield _scan_rows(part, named, run_id, np.diff(bounds), known, base, score)
                rare_doc, rare = doc[~common], t[~common]
                dealt, cuts = _split(rare & np.uint64(m.buckets - 1), m.buckets)
                full = np.flatnonzero(np.diff(cuts))
                if len(full):
                    yield _bucket_rows(part, named, run_id, full, [rare[dealt[cuts[i] : cuts[i + 1]]].tobytes() for i in full], [rare_doc[dealt[cuts[i] : cuts[i + 1]]].astype("<u4").tobytes() for i in full])
                run_id += 1

    schema = ", ".join([*fields, "run long, place int, n_tokens long, n_known long, base double, score double, bucket int, kind int, keys binary, counts binary"])
    source = docs.select(*(F.col(c).alias(a) for a, c in zip(named, keep, strict=True)), text.alias("_text"))
    seen = durable(source.mapInArrow(scan, schema))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_bucket, words, logs = -1, np.empty(0, np.uint64), np.empty(0)
        for b in batches:
            out: list[list] = [[], [], [], []]
            for bucket, kind, run, keys, raw in zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "run", "keys", "counts")), strict=True):
                if bucket != at_bucket:
                    at_bucket, words, logs = bucket, np.empty(0, np.uint64), np.empty(0)
                if kind == 1:  # comes first
                    words, logs = np.frombuffer(keys, "<u8"), np.log10(np.frombuffer(raw, "<i8") + ALPHA)
                    continue
                k, doc = np.frombuffer(keys, "<u8"), np.frombuffer(raw, "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(words, k), max(0, len(words) - 1))
                hit = words[at] == k if len(words) else np.zeros(len(k), bool)
                s = np.bincount(doc, np.where(hit, logs[at] if len(words) else 0.0, np.log10(ALPHA)))
                n_known = np.bincount(doc, hit).astype(np.int64)
                there = np.unique(doc)
                out[0].append(np.full(len(there), run))
                out[1].append(there)
                out[2].append(s[there])
                out[3].append(n_known[there])
            if out[0]:
                c = [np.concatenate(x) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.int64())], ["run", "place", "base", "known"])

    asked = seen.where("kind = 3").select("bucket", "kind", "run", "keys", "counts").unionByName(counts.where("kind = 1").select("bucket", "kind", F.lit(-1).cast("long").alias("run"), "keys", "counts"))
    found = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "run").mapInArrow(look_up, "run long, place int, base double, known long")
    sums = found.groupBy("run", "place").agg(F.sum("base").alias("_base"), F.sum("known").alias("_known"))
    rows = seen.where("kind = 0").join(sums, ["run", "place"], "left")
    share = float(np.log10(n + ALPHA * (v + 1)))
    return rows.select(
        *(F.col(a).alias(c) for a, c in zip(named, keep, strict=True)),
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0)) - F.col("n_tokens") * share).alias("base_score"),
        "score",
    )


_TAIL = ["run", "place", "n_tokens", "n_known", "base", "score", "bucket", "kind", "keys", "counts"]


def _scan_rows(part: pa.RecordBatch, named: list[str], run: int, n, known, base, score) -> pa.RecordBatch:
    m = part.num_rows
    cols = [pa.array(np.full(m, run), pa.int64()), pa.array(range(m), pa.int32()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.nulls(m, pa.int32()), pa.array(np.zeros(m), pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())]
    return pa.RecordBatch.from_arrays([*(part.column(a) for a in named), *cols], [*named, *_TAIL])


def _bucket_rows(part: pa.RecordBatch, named: list[str], run: int, bucket, keys: list[bytes], docs: list[bytes]) -> pa.RecordBatch:
    m = len(bucket)
    cols = [pa.array(np.full(m, run), pa.int64()), *(pa.nulls(m, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())), pa.array(bucket, pa.int32()), pa.array(np.full(m, 3), pa.int32()), pa.array(keys, pa.binary()), pa.array(docs, pa.binary())]
    return pa.RecordBatch.from_arrays([*(pa.nulls(m, part.column(a).type) for a in named), *cols], [*named, *_TAIL])


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 10) == 0, F.lit(False)))
    return score_text(rows, fold(F.col("doc_id"), 10) != 0, keep=("doc_id", "held_out"))
