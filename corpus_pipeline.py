"""A corpus pipeline: each stage reads what the stage before kept, and its decisions take effect."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsift.llm import decontaminate, mixing, neardup, quality, secrets
from reviewsift.llm.common import bounded, row_key, table
from reviewsift.llm.queries import vocabulary
from reviewsift.session import materialize


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The columns of ``documents``, which the stages name.
BASE = ("doc_id", "text", "lang", "source", "n_chars")


def guarded(stage: Stage) -> Stage:
    """The stage with further columns under names of its own, so that none can clash with a name it uses."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        hidden = {c: f"extra_{i}" for i, c in enumerate(docs.columns) if c not in BASE}
        shown = {h: c for c, h in hidden.items()}
        out = stage(spark, docs.toDF(*[hidden.get(c, c) for c in docs.columns]), sf_dir)
        return out.toDF(*[shown.get(c, c) for c in out.columns])

    return run_stage


@guarded
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.

    Null, empty and wordless texts fail them. Rows are judged by themselves, so repeated rows and null ids stay or go
    like any other; texts of any length are read whole. Further columns stay. No rows give no rows.
    """
    columns = docs.columns
    judged = docs.withColumn("_m", quality.measure(F.col("text"), vocabulary("piece_bpe_32k.model")))
    return judged.where(quality.kept(F.col("_m"))).select(*columns)


@guarded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class (five-word shingles, similarity 0.8 or more): the one with the smallest id.

    Of different texts of that id the one with the smallest key stays; a row without an id stays only where
    its class has no row with one. Rows of one id and text are copies and leave one; null, empty and wordless texts
    are copies of each other. Further columns stay (those of one of the copies). No rows give no rows.
    """
    found = neardup.similar_classes(docs)
    stays = F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("key") == F.col("rep_key"))
    drop = bounded(materialize(
        found.where(~stays).select(F.col("id").alias("_id"), F.col("key").alias("_key")).distinct(), "near-duplicates"))
    twice = bounded(materialize(
        docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "repeated"))
    rows = docs.withColumn("_row", row_key(F.col("text")))
    kept = rows.join(drop, rows["doc_id"].eqNullSafe(drop["_id"]) & (rows["_row"] == drop["_key"]), "left_anti")
    single = kept.join(twice, kept["doc_id"].eqNullSafe(twice["doc_id"]), "left_anti")
    several = kept.join(twice, kept["doc_id"].eqNullSafe(twice["doc_id"]), "left_semi")
    return single.unionByName(several.dropDuplicates(["doc_id", "_row"])).drop("_row")


@guarded
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Rows go by id and text, so another text of the same id stays; null, empty and wordless texts have no passage
    and stay. An empty benchmark drops nothing. Further columns stay. No rows give no rows.
    """
    hits, _, _ = decontaminate.contaminated_windows(docs, table(spark, sf_dir, "benchmark"))
    bad = bounded(materialize(hits.select(F.col("id").alias("_id"), F.col("key").alias("_key")).distinct(), "contaminated"))
    rows = docs.withColumn("_row", row_key(F.col("text")))
    return rows.join(bad, rows["doc_id"].eqNullSafe(bad["_id"]) & (rows["_row"] == bad["_key"]), "left_anti").drop("_row")


@guarded
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; ``n_chars`` follows the text.

    A null text stays null, and so does its ``n_chars``; repeated rows are redacted alike. Further columns stay. No
    rows give no rows.
    """
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@guarded
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``taken``, the words of them that the mix takes, repeats counted (see
    ``mixing.mix_sources``), and their ``size``, ``source_size`` and ``target``.

    A text is written ``taken // size`` times whole, and then its first ``taken % size`` words. Null, empty and
    wordless texts have size 0 and are never taken; a null source is one of its own; repeated rows and null ids
    are rows like any other. No rows give no rows.
    """
    rows = materialize(docs.withColumn("_place", F.monotonically_increasing_id()), "mixed")
    out = mixing.mix_sources(rows, carry=["_place"])
    taken = bounded(materialize(out.select("_place", "size", "source_size", "target", "taken"), "taken"))
    return rows.join(taken, "_place").drop("_place")


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mix", mix),
]

#: Fertility, SimHash and the redaction have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage is stored and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
