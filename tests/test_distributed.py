"""Positions, hot-key joins, quantiles and components against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewsift.operators import ordering
from reviewsift.operators.components import connected_components
from reviewsift.operators.quantiles import exact_quantiles, melt
from reviewsift.operators.regression import regression_metrics


def test_positions_with_a_hot_group_and_ties(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else str(i % 7), rng.choice([0.0, 0.0, 1.5, 2.5])) for i in rng.sample(range(9999), 2000)]
    df = spark.createDataFrame(rows, "row_id long, grp string, v double").repartition(5)
    got = ordering.with_position(df, [F.desc("v"), F.asc("row_id")], within=["grp"]).collect()
    assert len(got) == len(rows)
    for g in {r.grp for r in got}:
        mine = sorted((r for r in got if r.grp == g), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(len(mine)))
        assert [(r.v, r.row_id) for r in mine] == sorted(((r.v, r.row_id) for r in mine), key=lambda t: (-t[0], t[1]))


def test_position_uses_every_task(spark):
    df = spark.range(10000).select(F.col("id").alias("row_id"), F.lit("one").alias("grp"))
    assert ordering.with_position(df, [F.asc("row_id")], within=["grp"]).where("pos = row_id").count() == 10000


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join_equals_plain_join(spark, how):
    left = spark.range(5000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(
        F.col("id") % 50).cast("long").alias("k"))
    right = left.where("k < 40").groupBy("k").agg(F.count("*").alias("n"))
    plain = left.join(right, "k", how)
    spread = ordering.join_hot(left, right, ["k"], "n", "row_id", how=how, salts=8, floor=1000)
    assert ordering.hot_keys(right, ["k"], "n", 1000).count() == 1
    assert "_salt" in spread._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, plain.select("row_id", "k", "n").collect()), key=str) == sorted(
        map(tuple, spread.select("row_id", "k", "n").collect()), key=str)


def test_drop_members(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 2000, 1).otherwise(
        F.col("id") % 10).alias("cell"))
    members = df.where("cell in (1, 4)").groupBy("cell").agg(F.count("*").alias("rows"))
    left = ordering.drop_members(df, members, "cell", "rows", floor=500)
    assert {r.cell for r in left.select("cell").distinct().collect()} == {0, 2, 3, 5, 6, 7, 8, 9}
    assert left.count() == 800


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    data = {"x": np.round(rng.normal(size=999), 2), "y": np.zeros(500), "z": np.array([7.0])}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("x", None)]
    qs = [0.0, 0.01, 0.25, 0.5, 0.333, 0.99, 1.0]
    got = exact_quantiles(spark.createDataFrame(rows, "feature string, value double"), qs).collect()
    for r in got:
        assert r.n == len(data[r.feature])
        assert np.allclose(r.q, np.quantile(data[r.feature], qs), atol=1e-12)


def test_melt_booleans(spark):
    df = spark.createDataFrame([(True, 2)], "a boolean, b int")
    assert {r.feature: r.value for r in melt(df, ["a", "b"]).collect()} == {"a": 1.0, "b": 2.0}


@pytest.mark.parametrize("seed", [0, 1])
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(1, 200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in connected_components(
        spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_spearman_with_ties(spark):
    rng = np.random.default_rng(0)
    y, p = rng.integers(1, 6, 400).astype(float), np.round(rng.normal(3, 1, 400), 1)

    def ranks(v):
        order = np.sort(v)
        return np.array([(np.searchsorted(order, x, "left") + np.searchsorted(order, x, "right") + 1) / 2 for x in v])

    row = regression_metrics(spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "rating double, predicted_rating double")).first()
    assert np.isclose(row.spearman, np.corrcoef(ranks(y), ranks(p))[0, 1])
    assert np.isclose(row.mae, np.abs(y - p).mean()) and np.isclose(row.rmse, np.sqrt(((y - p) ** 2).mean()))
    assert np.isclose(row.r2, 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


@pytest.mark.parametrize("share", [2, 40])
def test_ids_are_dropped_without_shuffling_the_rows(spark, share):
    from reviewsift.session import materialize

    rows = materialize(spark.range(20000).select(
        F.when(F.col("id") % 997 != 0, F.col("id") * 7).alias("row_id"), F.lit("wide").alias("text")), "rows")
    ids = materialize(rows.where(F.col("row_id") % share == 0).select("row_id"), "ids")
    kept = ordering.without_ids(rows, "row_id", ids, rows.select("row_id"), rows=20)
    assert kept.columns == rows.columns
    plain = rows.join(ids, "row_id", "left_anti").select(*rows.columns)
    assert sorted(kept.collect(), key=str) == sorted(plain.collect(), key=str)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_repeats_beyond_a_broadcast_shuffle_no_text(spark, monkeypatch):
    from reviewsift.operators import dedup

    monkeypatch.setattr(ordering, "BROADCAST_ROWS", 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(3000).select(F.col("id").alias("row_id"), F.concat(F.lit("t"), F.col("id") % 700).alias("review_data"),
                                        F.lit(1.0).alias("rating"))
        kept = dedup.drop_duplicate_reviews(rows)
        assert sorted(r.row_id for r in kept.collect()) == list(range(700))
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
