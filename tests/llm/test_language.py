"""Held-out accuracy of the language hierarchy, and what it must not look at."""

import zlib

import numpy as np
import pytest

from reviewsift.llm import language

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def identified(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, language.identify(docs).collect()


def test_held_out_accuracy(identified):
    docs, got = identified
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out and lang[r.id]]
    assert len(out) > 200
    assert np.mean([r.lang_pred == lang[r.id] for r in out]) > 0.95
    per = {c: np.mean([r.lang_pred == c for r in out if lang[r.id] == c]) for c in set(lang.values()) if c}
    assert min(per.values()) > 0.8


def test_edges(spark):
    words = {"en": "the house and the tree of this thing", "de": "das haus und der baum nicht für über straße", "fr": "la maison et les arbres où était ça"}
    rows = [(i, f"{words[c]} {i % 7}", c) for i, c in enumerate(["en", "de", "fr"] * 12)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !!", "fr"), (103, words["de"], None), (None, words["fr"], "fr"), (None, words["fr"], "fr"),
             (104, words["en"] * 20_000, None), (105, "x", "xx-unlisted")]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "doc_id long, text string, lang string, h string, rank int")
    got = language.identify(df, per_language=5).collect()
    pred = {r.id: (r.lang_pred, r.score) for r in got}
    assert len(got) == len(rows)
    assert all(pred[i] == ("und", 0.0) for i in (100, 101, 102))
    assert pred[103][0] == "de" and pred[104][0] == "en" and [r.lang_pred for r in got if r.id is None] == ["fr", "fr"]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.identify(df).collect()} == {("und", 0.0)}
    assert language.identify(df.limit(0)).count() == 0


def test_profile_of_long_texts_is_that_of_slabs(monkeypatch):
    text = "Der schnelle Fuchs springt über den faulen Hund. " * 50
    whole = language.profile(text)
    monkeypatch.setattr(language, "SLAB", 64)
    assert np.allclose(whole, language.profile(text))
