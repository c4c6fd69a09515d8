"""The corpus pipeline, stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from reviewsift.llm import decontaminate, mixing, neardup, quality, secrets
from reviewsift.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = [docs.cache()]
    for _, stage in cp.STAGES:
        made.append(cp.materialize(stage(spark, made[-1], sf), "test"))
    return made


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_order_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "mix"]
    assert all(df.columns == COLUMNS for df in stages[:-1])


def test_each_stage_does_its_operators_work(spark, sf, stages):
    docs, good, single, clean, redacted, mixed = stages
    assert ids(good) == sorted(r.id for r in quality.quality(docs, vocabulary("piece_bpe_32k.model")).where("kept").collect())
    classes = neardup.similar_classes(good).collect()
    assert ids(single) == sorted({r.rep_id for r in classes}) and len(ids(single)) < len(ids(good))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    hit = {r.id for r in decontaminate.decontaminate(single, bench).where("contaminated").collect()}
    assert ids(clean) == [i for i in ids(single) if i not in hit] and hit
    assert ids(redacted) == ids(clean)
    assert secrets.secret_spans(redacted).where("kind <> 'assign'").count() == 0
    assert redacted.where("n_chars <> length(text)").count() == 0
    key = lambda r: r[0]
    assert sorted(((r.doc_id, r["size"], r.taken) for r in mixed.collect()), key=key) == sorted(
        ((r.id, r["size"], r.taken) for r in mixing.mix_sources(redacted).collect()), key=key)
    assert mixed.columns == [*COLUMNS, "size", "source_size", "target", "taken"]
    assert mixed.select(*COLUMNS).exceptAll(redacted).isEmpty() and mixed.count() == redacted.count()


def test_edges(spark, sf, stages):
    prose = stages[3].where("n_chars BETWEEN 800 AND 2000 AND lang = 'en'").orderBy("doc_id").limit(3).collect()
    a, b, c = (r.text for r in prose)
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (2, a, "en", "t", 1), (None, a, "en", None, 1), (None, b, "en", None, 1), (4, None, None, None, None),
            (5, "", "en", "s", 0), (6, c + " token=abcdefgh", None, None, None), (7, c + "x" * 200_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        docs = cp.materialize(stage(spark, docs, sf), "edges")
    got = {r.doc_id: r for r in docs.collect()}
    assert len(got) == docs.count() and not {2, 4, 5} & set(got)
    assert got[None].text == b and "abcdefgh" not in got[6].text and sum(r.taken for r in got.values()) > 0
    empty = docs.limit(0)
    start = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        start = cp.materialize(stage(spark, start, sf), "none")
    assert start.count() == 0 and start.columns == empty.columns


def test_further_columns_stay_whatever_their_names(spark, sf):
    names = ["_m", "_row", "_id", "_key", "_cuts", "_place", "id", "key", "size", "taken", "extra_0"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    wide = docs.select("*", *[F.concat(F.lit(n), F.lit(":"), F.col("doc_id")).alias(n) for n in names])
    wide = cp.materialize(wide, "wide")
    for name, stage in cp.STAGES[:-1]:
        wide = cp.materialize(stage(spark, wide, sf), name)
        assert wide.columns == COLUMNS + names
    assert wide.count() > 5
    for n in names:
        assert wide.where(f"`{n}` <> '{n}:' || doc_id").isEmpty()
    last = cp.STAGES[-1][1](spark, wide.drop("size", "taken"), sf)
    assert last.columns == COLUMNS + [n for n in names if n not in ("size", "taken")] + ["size", "source_size", "target", "taken"]
