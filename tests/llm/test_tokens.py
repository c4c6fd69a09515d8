"""Token counts against the tokenizer library."""

import random

import pytest
from tokenizers import Tokenizer

from reviewsift.llm import tokens
from reviewsift.llm.queries import vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def n_tokens(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


CASES = [None, "", "   ", "Hello, WORLD's I'LL don't", "ΣΑΣ Σ", "İstanbul", "café é", "a\x85b\xa0c​d\x1ce", "12345 ½ １２",
         "<|endoftext|>", "x<|startoftext|>y <|ENDOFTEXT|>", "漢字かな😀👍🏽", "a" * 3000, "é" * 999, "!?" * 400, "ﬁ ǅ ß ſ K", "가 각"]


def test_documents_and_cases(spark, sf, library):
    texts = CASES + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["long words " * 90_000]
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, id string")
    got = {r.id: r for r in tokens.count_tokens(df, vocabulary("word_bpe_49k.json")).collect()}
    for i, t in enumerate(texts):
        want = n_tokens(library, t)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), want, want > 2048), t and t[:60]


def test_random_texts(library):
    rng = random.Random(7)
    vocab = tokens.Vocabulary(vocabulary("word_bpe_49k.json"))
    pool = ["the", "ing", "'s", "'RE", " ", "\n", "É", "σ", "Σ", "́", "9", "_", "--", "ж", "字", "<|endoftext|>", "‍", "😀"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) if rng.random() < 0.8 else chr(rng.randrange(32, 0x500)) for _ in range(rng.randrange(12)))
        assert vocab.count(text) == n_tokens(library, text), ascii(text)


def test_no_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    path = vocabulary("word_bpe_49k.json")
    assert [tuple(r) for r in tokens.count_tokens(df, path).collect()] == [(None, 3, 2, False)] * 2
    assert tokens.count_tokens(df.limit(0), path).count() == 0
