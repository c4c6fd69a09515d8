"""Sketches against exact counts and ranks."""

from pyspark.sql import functions as F

from reviewsift.operators import sketches as S
from reviewsift.sources.readers import dataset_profile


def test_merged_slices_are_the_whole(spark):
    df = spark.range(200_000).select(
        (F.col("id") % 7).alias("day"), (F.col("id") * 7919 % 50_021).alias("user"), F.concat(F.lit("p"), F.col("id") % 900).alias("item"),
        F.sqrt("id").alias("x"))
    kept = S.slice_sketches(df, ["day"], ["user", "item"], ["x"])
    assert kept.count() == 7
    row = S.sketch_profile(S.merge_sketches(kept), [0.1, 0.5, 0.9]).first()
    assert row.rows == 200_000
    for name, exact in (("user", 50_021), ("item", 900)):
        assert abs(row[f"distinct_{name}"] - exact) <= 4 * S.distinct_error() * exact
    for q, x in zip((0.1, 0.5, 0.9), row.quantiles_x):
        assert abs(x * x / 200_000 - q) <= S.RANK_ERROR
    days = {r.day: r for r in S.sketch_profile(kept).collect()}
    assert len(days) == 7 and sum(r.rows for r in days.values()) == 200_000


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", float("nan")), (3, "a", 2.0)], "k long, s string, x double")
    row = S.sketch_profile(S.merge_sketches(S.slice_sketches(df, ["k"], ["s"], ["x"])), [0.5]).first()
    assert row.rows == 3 and row.distinct_s == 1 and row.quantiles_x == [2.0]
    none = S.slice_sketches(df.where("false"), ["k"], ["s"])
    assert none.count() == 0


def test_profile_by_sketches(spark):
    df = spark.range(5000).selectExpr("id % 300 as user_id", "concat('a', id % 41) as asin", "id as timestamp")
    exact, approx = dataset_profile(df).first(), dataset_profile(df, approx=True).first()
    assert exact[0] == approx[0] and exact[3:] == approx[3:]
    assert all(abs(a - e) <= 4 * S.distinct_error() * e for a, e in zip(approx[1:3], exact[1:3]))
