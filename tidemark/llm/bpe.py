"""BPE encoding and decoding, long texts by tree concatenation.

A long text is halved until its pieces are short, the pieces are encoded in parallel
(``encode_batch``), and the halves are joined again from the bottom up. At each join a window
around the cut is encoded afresh. It has to show, on either side of the cut, two neighbouring tokens
that the half's own encoding has at the same places; if it doesn't, the window doubles, at most to
both halves whole. What is kept is the left half up to its agreeing tokens, the window between,
and the right half from its agreeing tokens.

That is exact: a sequence of BPE tokens is the encoding of its text if each pair of neighbours is
the encoding of the pair's own text, and here each pair of neighbours stands in an encoding that
was made whole. Cuts are made in the normalised text, so normalisation never sees a window.

A text of at most LEAF_CHARS characters is split at ASCII white space, which no token spans and
no normalisation crosses; its words' ids come from a table of words seen before (at most
twice CACHE_WORDS) or from the tokenizer. Only a batch of documents is held by a task; there is no shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import bounded_batches, kept, lean
from tidemark.llm.words import chunks

#: Texts up to so many characters are encoded in one piece; longer ones in pieces of so many bytes.
LEAF_CHARS = 16_384
#: Text bytes that are encoded before their rows are handed on.
BATCH_BYTES = 500_000
#: Words whose ids a table keeps, and as many again of those used before.
CACHE_WORDS = 120_000
#: First half-width, in bytes, of the window around a join.
WINDOW_CHARS = 48


#: A full stop or comma after an ASCII letter and before white space is a token run of its own.
_STOP = re.compile(rb"(?<=[a-z])([.,])(?=[ \t-\r]|$)")


#: Texts that an encoder is tried with when it is made.
PROBES = ("", "a", "A b", "Word, word. End", "a.b a,b a., .a ,b", "x.\ty,\nz\x0bq\x0cr", "it's don't 3.14 1,000. e.g. ", "über Éa. ñandú, naïve...", "--a.. b,, (c). [d], e!. f?", "日本語. テキスト, 한국어.", "a\u00a0b.\u2003c, d\u0301. 🙂.")


class WordTable:
    """Ids of words (runs between white space) under one tokenizer, kept in two generations."""

    def __init__(self, tokenizer, ends: np.ndarray) -> None:
        self.tokenizer, self.ends = tokenizer, ends
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts that are lower-cased as to A-Z."""
        words = [_STOP.sub(rb" \1", t).split() for t in texts]
        if new := set().union(*words).difference(self.known):
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known, self.older = {}, self.known
                new = set().union(*words)
            again = new & self.older.keys()
            self.known.update((w, self.older[w]) for w in again)
            self._learn(list(new - again))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, w)), "<u4") for w in words]

    def _learn(self, words: list[bytes]) -> None:
        """Words of letters only go to the tokenizer as one text: each ends where a token ends a word."""
        text = [w.decode() for w in words]
        letters = [i for i, t in enumerate(text) if t.isalpha()]
        if letters:
            ids = np.array(self.tokenizer.encode(" ".join([text[i] for i in letters]), add_special_tokens=False).ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) == len(letters):
                raw, cuts = ids.tobytes(), cuts.tolist()
                self.known.update((words[i], raw[a:b]) for i, a, b in zip(letters, [0, *cuts], cuts, strict=False))
            else:  # the tokenizer splits some word of letters
                letters = []
        done = set(letters)
        rest = [i for i in range(len(words)) if i not in done]
        found = self.tokenizer.encode_batch_fast([text[i] for i in rest], add_special_tokens=False)
        self.known.update((words[i], np.array(e.ids, "<u4").tobytes()) for i, e in zip(rest, found, strict=True))


class TreeEncoder:
    """Encodes as ``Tokenizer.encode(text, add_special_tokens=False)`` of the file does.

    Word tables and windows rely on what not every vocabulary has; ValueError where it hasn't (``_require``), or where
    PROBES don't come out as from the library.
    """

    def __init__(self, tokenizer_path: str, leaf_chars: int = LEAF_CHARS, window_chars: int = WINDOW_CHARS) -> None:
        from tokenizers import Tokenizer

        spec = json.load(open(tokenizer_path, encoding="utf-8"))
        self._require(spec)
        self.whole = Tokenizer.from_file(tokenizer_path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # The same model on text that is already normalised and holds no special token.
        self.plain = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "normalizer": None, "truncation": None, "padding": None}))
        suffix, vocab = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        top = max([*vocab.values(), *self.special.values()]) + 1
        #: Bytes of text of each id, and whether it ends a word. Each character of a token is a byte.
        self.n_bytes, ends = np.zeros(top, np.int64), np.zeros(top, bool)
        for token, i in vocab.items():
            self.n_bytes[i], ends[i] = len(token.removesuffix(suffix)), token.endswith(suffix)
        self.raw_words, self.plain_words = WordTable(self.whole, ends), WordTable(self.plain, ends)
        self.leaf, self.window = leaf_chars, window_chars
        for text in PROBES:
            if self.whole.encode(text, add_special_tokens=False).ids != self.encode([text])[0].tolist():
                raise ValueError(f"the vocabulary doesn't split at white space, full stops and commas as it must: {text!r}")

    @staticmethod
    def _require(spec: dict) -> None:
        """ValueError unless tokens mark the ends of words, and none of two bytes and more holds white space.

        (Each byte by itself is a token; the split before the merges drops those of white space.)
        """
        space = {chr(256 + i) for i in (9, 10, 11, 12, 13, 32)} | set(" \t\n\r\v\f")
        suffix = spec["model"].get("end_of_word_suffix")
        if spec["model"].get("type") != "BPE" or not suffix:
            raise ValueError("the tokenizer must be a BPE with a suffix at the ends of words")
        if any(space & set(t) for t in spec["model"]["vocab"] if len(t.removesuffix(suffix)) > 1):
            raise ValueError("a token of the vocabulary holds white space beside other characters")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list = [None] * len(texts)
        short = []
        for i, t in enumerate(texts):
            if len(t) > self.leaf:
                out[i] = self._long(t)
            elif any(map(t.lower().__contains__, self.special)):
                out[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4")
            else:
                short.append(i)
        for i, ids in zip(short, self.raw_words.encode([texts[i].encode().lower() for i in short]), strict=True):
            out[i] = ids
        return out

    def _long(self, text: str) -> np.ndarray:
        parts = []
        for piece, special in self._segments(text):
            if special is not None:
                parts.append(np.array([special], "<u4"))
            elif piece:
                parts.append(self.tree(self.whole.normalizer.normalize_str(piece) if self.whole.normalizer else piece))
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def _segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Text between special tokens, and these; the leftmost goes first, of those the longest."""
        at = 0
        while True:
            found = [(p, -len(s), s) for s in self.special if (p := text.find(s, at)) >= 0]
            if not found:
                yield text[at:], None
                return
            p, _, s = min(found)
            yield text[at:p], None
            yield "", self.special[s]
            at = p + len(s)

    def tree(self, text: str) -> np.ndarray:
        """Ids of a normalised text. Places below are in its bytes."""
        raw = text.encode()
        bounds = self._halves(raw)
        level = list(zip(bounds, bounds[1:], self._leaves([raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]), strict=False))
        while len(level) > 1:
            level = [(x[0], y[1], self._join(raw, x, y)) for x, y in zip(level[::2], level[1::2], strict=True)]
        return level[0][2]

    def _leaves(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Pieces with spaces go word by word; unsplit ones go to the library's threads together."""
        out = dict(enumerate(self.plain_words.encode([p if b" " in p else b"" for p in pieces])))
        unsplit = [i for i, p in enumerate(pieces) if p and b" " not in p]
        if unsplit:
            before = os.environ.get("TOKENIZERS_PARALLELISM")
            os.environ["TOKENIZERS_PARALLELISM"] = "true"
            found = self.plain.encode_batch_fast([pieces[i].decode() for i in unsplit], add_special_tokens=False)
            os.environ["TOKENIZERS_PARALLELISM"] = before or "false"
            out.update(zip(unsplit, (np.array(e.ids, "<u4") for e in found), strict=True))
        return [out[i] for i in range(len(pieces))]

    def _halves(self, raw: bytes) -> list[int]:
        """Bounds of equal pieces, a power of two of them, none longer than a leaf."""
        n = 1
        while len(raw) > n * self.leaf:
            n *= 2
        return [self._char_start(raw, len(raw) * k // n) for k in range(n + 1)]

    @staticmethod
    def _char_start(raw: bytes, at: int) -> int:
        """The place itself, or else the start of the character that it lies in."""
        while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
            at -= 1
        return at

    def _forward(self, raw: bytes, at: int, stop: int, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """``(start, end, id)`` of the first ids up to ``stop``. Only spaces lie between tokens."""
        out = []
        for i, n in zip(ids.tolist(), self.n_bytes[ids].tolist(), strict=True):
            while at < len(raw) and raw[at] == 32:
                at += 1
            if at + n > stop:
                break
            out.append((at, at + n, i))
            at += n
        return out

    def _backward(self, raw: bytes, at: int, stop: int, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """The same for the last ids down to ``stop``, last one first."""
        out = []
        for k in range(len(ids) - 1, -1, -1):
            while at > 0 and raw[at - 1] == 32:
                at -= 1
            n = int(self.n_bytes[ids[k]])
            if at - n < stop:
                break
            out.append((at - n, at, int(ids[k])))
            at -= n
        return out

    def _join(self, raw: bytes, left: tuple, right: tuple) -> np.ndarray:
        (a, cut, x), (_, b, y) = left, right
        width = self.window
        while True:
            lo, hi = self._char_start(raw, max(a, cut - width)), self._char_start(raw, min(b, cut + width))
            mid = np.array(self.plain.encode(raw[lo:hi].decode(), add_special_tokens=False).ids, "<u4")
            if lo == a and hi == b:
                return mid
            at = {t: k for k, t in enumerate(self._forward(raw, lo, hi, mid))}
            start, stop = (0, 0), (len(y), len(mid))
            if lo > a:
                tail = self._backward(raw, cut, lo, x)
                # Not the half's last token, which may end there only because of the cut.
                start = next(((len(x) - k, at[t] + 1) for k, t in enumerate(tail[:-1]) if t[1] < cut and at.get(t, 0) > 0 and at.get(tail[k + 1]) == at[t] - 1), None)
            if hi < b:
                head = self._forward(raw, cut, hi, y)
                stop = next(((k, at[t]) for k, t in enumerate(head[:-1]) if t[0] > cut and t in at and at[t] + 2 < len(mid) and at.get(head[k + 1]) == at[t] + 1), None)
            if start and stop and start[1] <= stop[1]:
                return np.concatenate((x[: start[0]], mid[start[1] : stop[1]], y[stop[0] :]))
            width *= 2

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)


def encoder(tokenizer_path: str, leaf_chars: int, window_chars: int) -> TreeEncoder:
    """The worker's encoder; it outlives a task, and so do the words that it knows, until another operator's task."""
    key = (tokenizer_path, leaf_chars, window_chars)
    return kept("bpe", key, lambda: TreeEncoder(*key))


def encode_decode(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    leaf_chars: int = LEAF_CHARS,
    window_chars: int = WINDOW_CHARS,
    digests: bool = False,
) -> DataFrame:
    """Ids and decoded text of each row: ``id_col``, ``ids`` array<bigint>, ``decoded`` string.

    With ``digests``, instead of these: ``n_tokens``, ``ids_sha256`` (of the ids as little-endian
    unsigned 32-bit integers) and ``decoded_sha256`` (of the UTF-8 text), made where the ids are, so
    that they never leave the task. A null text counts as empty and has no ids. Rows are
    independent: repeated rows and null ids give a row each, an empty table gives none, and
    other columns are ignored. The tokenizer file has to be at the same path on every worker.
    """
    kind = dict(docs.dtypes)[id_col]
    bounded_batches(docs.sparkSession)
    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<long>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # threads only pay for the pieces of long words
        enc = encoder(tokenizer_path, leaf_chars, window_chars)
        for whole in batches:
            for a, b in chunks(whole.column("text"), BATCH_BYTES):
                part = whole.slice(a, b - a)
                ids = enc.encode(part.column("text").to_pylist())
                decoded = enc.decode([x.tolist() for x in ids])
                if digests:
                    sums = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids], [hashlib.sha256(t.encode()).hexdigest() for t in decoded]
                    more = {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_sha256": pa.array(sums[0], pa.string()), "decoded_sha256": pa.array(sums[1], pa.string())}
                else:
                    more = {"ids": pa.array([x.astype("int64") for x in ids], pa.list_(pa.int64())), "decoded": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_arrays([part.column("id"), *more.values()], ["id", *more])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.mapInArrow(lean("bpe", run), f"id {kind}, {more}")
    return out.withColumnRenamed("id", id_col)


def tokenizer_path() -> str:
    """The public vocabulary that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, tokenizer_path(), digests=True)
