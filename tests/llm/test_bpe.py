"""Ids against the tokenizers library, which reads the same public file."""

import base64
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quireflow.llm.bpe import PATTERN, TOKENIZERS, Encoder, Merges, decode_corpus, encode_corpus

FILE = f"{TOKENIZERS}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Merges.load(FILE))


def ids(encoder, texts):
    flat, n = encoder.encode(texts)
    return [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]


def test_kinds_of_text(encoder, theirs):
    rng = random.Random(0)
    texts = ["<|endoftext|> a", "a" * 5000, "-" * 10_001, "=-" * 3000, " \n\n\t x", "it's I'LL we'll", "日本語テキスト" * 500, "ab" * 1000, "x" * 256, "x" * 257, "̀é", "👍🏽", "", " "]
    texts += ["".join(rng.choice("abcdehilnorst -ф\n") for _ in range(rng.randint(1, 900))) for _ in range(200)]
    texts += ["".join(rng.choice("abcdehilnorst") for _ in range(rng.randint(250, 600))) for _ in range(40)]
    assert ids(encoder, texts) == theirs(texts)
    assert ids(encoder, texts) == theirs(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=40), min_size=1, max_size=8))
def test_any_text(encoder, theirs, texts):
    assert ids(encoder, texts) == theirs(texts)


def test_ranks_file_of_another_tokenizer():
    file = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["naïve Übergröße żółć съешь ещё", "日本語テキスト" * 50, "=" * 700, *["".join(rng.choice("aеéiöż日 -\n") for _ in range(rng.randint(1, 400))) for _ in range(100)]]
    assert ids(Encoder(Merges.load(file)), texts) == [theirs.encode_ordinary(t) for t in texts]


def test_other_kinds_of_tokenizer_are_refused():
    with pytest.raises(ValueError):
        Merges.load(f"{TOKENIZERS}/word_bpe_49k.json")


def test_frames(spark, theirs):
    rows = [(1, "a b", "x"), (2, None, None), (3, "", "x"), (None, "c", "x"), (1, "a b", "x"), (5, "long " * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key string")
    got = encode_corpus(df, "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, list(r.ids)) for r in got) == sorted((k or 0, theirs([t])[0] if t else []) for k, t, _ in rows)
    sizes = {r.doc_id: r.n_tokens for r in encode_corpus(df, "doc_id", "text", only_sizes=True).collect()}
    assert sizes == {k: len(theirs([t])[0]) if t else 0 for k, t, _ in rows}
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_ids_stand_for_the_texts(spark):
    rows = [(1, "naïve 日本 <|endoftext|>\n"), (2, ""), (3, None), (None, "x" * 3000), (1, "twice"), (1, "twice")]
    df = spark.createDataFrame(rows, "key bigint, text string")
    for file in (FILE, f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"):
        got = decode_corpus(encode_corpus(df, "key", "text", file), "key", "ids", file).collect()
        assert sorted(map(str, ((r.key, r.text) for r in got))) == sorted(map(str, ((k, t or "") for k, t in rows)))
    empty = spark.createDataFrame([(1, None)], "key int, ids array<int>")
    assert decode_corpus(empty, "key", "ids").first().text is None and decode_corpus(empty.limit(0), "key", "ids").count() == 0
