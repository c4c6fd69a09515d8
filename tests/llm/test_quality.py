"""Base measures against brute force; the verdict on clean and noisy texts."""

import math
import re
from collections import Counter

import pytest

from reviewsift.llm import quality as q
from reviewsift.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": dup, "n_repeat_words": len(inside), "base_failed": n < 20 or 100 * len(inside) > 30 * n}


PHRASE = "one two three four five six seven eight "
CASES = [None, "", " \n\t ", "a\x1cb\x85c\xa0d e", "same\nsame\nsame \n\n \nsame", PHRASE * 2, PHRASE + "and more of it " + PHRASE, "w " * 9, "w " * 8,
         "x " * 40_000, "é" * 100_000, "<b>**</b> " * 30, "Привет мир это обычный русский текст " * 5, "漢字かな交じり文です " * 30, "#" * 20]


@pytest.fixture(scope="module")
def rows(spark, sf):
    texts = CASES + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame([(i if i else None, t, 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, _m string")
    return texts, {r.id or 0: r for r in q.quality(df, vocabulary("piece_bpe_32k.model")).collect()}


def test_base(rows):
    texts, got = rows
    for i, t in enumerate(texts):
        want = brute(t)
        assert {k: got[i][k] for k in want} == want, (t or "")[:80]
        assert not (got[i].kept and want["base_failed"])


def test_fertility(rows):
    import sentencepiece

    texts, got = rows
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    for i in list(range(len(CASES))) + list(range(len(CASES), len(texts), 10)):
        ids = [t for w in WORD.findall(texts[i] or "") for t in model.encode(w)]
        counts = Counter(ids)
        assert got[i].n_tokens == len(ids)
        assert got[i].n_byte_tokens == sum(n for t, n in counts.items() if model.is_byte(t))
        entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in counts.values())
        assert got[i].entropy == pytest.approx(entropy)


def test_scripts(rows):
    _, got = rows
    assert [got[i].script for i in (0, 5, 12, 13, 14)] == ["other", "latin", "cyrillic", "other", "other"]


def test_clean_texts_stay_and_noise_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = q.quality(docs, vocabulary("piece_bpe_32k.model")).where("NOT base_failed").withColumnRenamed("id", "doc_id")
    got = {r.quality: r for r in out.join(labels, "doc_id").groupBy("quality").agg(
        {"kept": "count", "n_words": "avg"}).collect()}
    kept = {r.quality: r["count"] for r in out.where("kept").join(labels, "doc_id").groupBy("quality").count().collect()}
    assert kept[1] >= 0.99 * got[1]["count(kept)"]
    assert kept[0] <= 0.5 * got[0]["count(kept)"]


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert q.quality(df, vocabulary("piece_bpe_32k.model")).count() == 0
