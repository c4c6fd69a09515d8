"""Physical plans: no pair products, no single-task windows, pruned scans."""

import inspect
import re
from pathlib import Path

import pytest

import reviewsift
from __spark_entry__ import MODULES, oracle_sql, queries
from reviewsift import fixtures as fx
from reviewsift.operators import dbscan as D
from reviewsift.operators.ordering import with_position
from reviewsift.session import materialize, scratch_root
from pyspark.sql import functions as F
from tools.check import connect, differences

ROOT = Path(inspect.getfile(reviewsift)).parent


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbour_joins_are_equi_joins(spark, sf):
    c = D.dbscan(materialize(fx.enriched(spark, sf), "t"), 0.6, 12)
    seen = [plan(c.labels()), plan(c.sparse_core)]
    here = c.sparse.select("row_id", "tile", *D.Z_COLUMNS)
    seen.append(plan(c.grid.near_tiles(here).alias("p").join(here.alias("q"), "tile").where(
        D.squared_distance("p", "q") <= 0.36).groupBy("p.row_id").count()))
    for text in seen:
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_positions_do_not_gather_rows(spark):
    out = with_position(spark.range(1000).withColumnRenamed("id", "row_id"), [F.asc("row_id")])
    text = plan(out)
    # the only single-task window runs over one row per slice
    assert text.count("SinglePartition") <= 1 and "HashAggregate" in text.split("SinglePartition")[-1]


def test_scans_are_pruned(spark, sf):
    text = plan(queries()["reviews_per_user"](spark, sf))
    assert "ReadSchema: struct<user_id:bigint>" in text and "PushedFilters: [IsNotNull(user_id)]" in text


def test_checkpoint_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or scratch_root(spark) == configured


def test_forbidden_calls_are_absent():
    for file in ROOT.rglob("*.py"):
        text = file.read_text()
        assert not re.search(r"localCheckpoint|crossJoin|\.rdd\b|F\.udf\(", text), file


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    names = [n for m in MODULES for n in m.QUERIES]
    assert len(names) == len(set(names)) and set(names) <= set(queries())


@pytest.mark.parametrize("name", [
    "build_dataset", "enrich_reviews", "winsorize_p99", "dbscan_labels", "detect_anomalies", "dbscan_batched",
    "k_distance_stats", "boxplot_stats", "user_percentiles", "length_stats", "spam_users", "evaluation_report",
    "regression_metrics", "clean_text", "tokenize_text",
])
def test_query_equals_sql(spark, sf, name):
    got = queries()[name](spark, sf).toPandas()
    assert differences(got, connect(sf).execute(oracle_sql()[name]).df()) == ""


def test_ngram_terms_are_counted_inside_the_rows(spark, sf):
    from reviewsift.catalog import texts
    plan = texts.ngram_terms(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning(row_id" in plan.replace("doc_id", "row_id")
