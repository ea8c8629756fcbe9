import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe

PATH = bpe.tokenizer_path()
WHOLE = bpe.TreeEncoder(PATH)
TREE = bpe.TreeEncoder(PATH, leaf_chars=24, window_chars=4)


def brute(text):
    return WHOLE.whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abenrthiosé'!. \nÀİ1ñß日́<|", max_size=200))
def test_tree_is_exact(text):
    assert TREE.encode([text])[0].tolist() == brute(text)


@pytest.mark.parametrize("seed", range(8))
def test_long_unsplit_text(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["the", "in", "an", "er", "'s", "'", "!", "!!'", "ll", "tion", "日", "🙂", "é", "x"][: 4 + seed * 2]) for _ in range(3000))
    assert TREE.encode([text])[0].tolist() == brute(text)


def test_special_tokens_and_odd_texts():
    for text in ["", " ", "a<|endoftext|>b" * 30, "<|startoftext|>" * 5, "<|ENDOFTEXT|> x" * 20, "don't we'll they're 'llama " * 20, "a" * 5000, "!" * 999, "\n\t  " * 100]:
        assert TREE.encode([text])[0].tolist() == brute(text), text[:20]


def test_frame(spark):
    rows = [(1, "The thing", "a"), (None, None, "b"), (1, "The thing", "a"), (2, "", None), (3, "word " * 9000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, r.decoded): list(r.ids) for r in bpe.encode_decode(df, PATH).collect()}
    for i, t, _ in rows:
        ids = brute(t or "")
        assert got[(i, WHOLE.whole.decode(ids, skip_special_tokens=False))] == ids
    assert bpe.encode_decode(df, PATH).count() == 5
    assert bpe.encode_decode(df.limit(0), PATH, digests=True).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abenrth.,'! \n\té́  İ日🙂<|19-", max_size=120))
def test_default_leaf_is_exact(text):
    assert WHOLE.encode([text])[0].tolist() == brute(text)


def test_default_leaf_on_a_very_long_text():
    r = random.Random(1)
    text = " ".join(r.choice(["thing.", "naïve,", "x" * r.randrange(1, 90), "日本", "o'clock", "3.14"]) for _ in range(40_000))
    assert len(text) > 10 * bpe.LEAF_CHARS and WHOLE.encode([text])[0].tolist() == brute(text)


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="BPE with a suffix"):
        bpe.TreeEncoder(public_tokenizers.path("byte_bpe_50k.json"))
