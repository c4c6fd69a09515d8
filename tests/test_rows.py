import pytest
from pyspark.sql import functions as F

from reviewsift.operators import dedup, enrich, splits, validate
from reviewsift.schemas import RAW_REVIEW


def raw(spark, *changes):
    base = dict(row_id=0, category="Books", rating="4.0", title="T", text="good text", images=None, asin="a1",
                parent_asin="p1", user_id=" u1 ", timestamp=5, verified_purchase=True, helpful_vote="3")
    rows = [{**base, "row_id": i, **c} for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[f.name] for f in RAW_REVIEW.fields) for r in rows], RAW_REVIEW)


def test_reject_reasons_in_order(spark):
    cases = [
        ({}, None), ({"title": None, "rating": "9"}, "missing_field"), ({"text": "<br>"}, "empty_text"),
        ({"text": " \t "}, None), ({"text": " "}, "empty_text"),
        ({"rating": "0.5"}, "bad_rating"), ({"rating": "NaN"}, "bad_rating"), ({"rating": "x"}, "bad_rating"),
        ({"helpful_vote": "-1"}, "bad_helpful_vote"), ({"helpful_vote": "-0.5"}, None),
        ({"helpful_vote": "many"}, "bad_helpful_vote"), ({"timestamp": 0}, "bad_timestamp"),
        ({"user_id": "  "}, "blank_id"), ({"text": "w " * 600}, "too_long"),
    ]
    got = validate.check_reviews(raw(spark, *[c for c, _ in cases])).orderBy("row_id").collect()
    assert [r.reject_reason for r in got] == [reason for _, reason in cases]
    assert got[0].user_id == "u1" and got[0].review_data == "[CAT=Books] [TITLE=T] good text"


def test_has_images(spark):
    df = raw(spark, {"images": None}, {"images": []}, {"images": [("x",)]})
    assert [r[0] for r in df.orderBy("row_id").select(validate.has_images("images")).collect()] == [False, False, True]


def test_missing_column_is_reported(spark):
    with pytest.raises(ValueError, match="helpful_vote"):
        validate.check_reviews(raw(spark, {}).drop("helpful_vote"))


def test_complete_rows_zero_means_all(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "row_id long, x string")
    assert validate.complete_rows(df, 0).count() == 2
    assert [r.row_id for r in validate.complete_rows(df, 1).collect()] == [1]


def test_first_copy_is_kept_when_most_rows_are_copies(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, "same").otherwise(
        F.col("id").cast("string")).alias("review_data"), F.lit(1.0).alias("rating"))
    kept = {r.row_id for r in dedup.drop_duplicate_reviews(df).collect()}
    assert kept == {i for i in range(1000) if i % 3 == 0} | {1}
    assert dedup.duplicate_counts(df, ["review_data"]).first().removed == 1000 - len(kept)
    assert dedup.drop_duplicate_rows(df).count() == len(kept)


@pytest.mark.parametrize("sizes, expected", [
    ((2, 1, 1), {"a": "2 1 1", "b": "2 1 0", "c": "1 0 0"}),
    ((10, 5, 5), {"a": "6 0 0", "b": "3 0 0", "c": "1 0 0"}),
    ((0, 2, 1), {"a": "0 2 1", "b": "0 2 1", "c": "0 1 0"}),
])
def test_short_categories_starve_the_later_splits(spark, sizes, expected):
    rows = [(i * 7 % 100, c) for i, c in enumerate("aaaaaabbbc")]
    out = splits.split_dataset(spark.createDataFrame(rows, "row_id long, category string"), *sizes)
    got = {}
    for c in "abc":
        mine = [r for r in out.collect() if r.category == c]
        got[c] = " ".join(str(sum(r.split == s for r in mine)) for s in ("train", "val", "test"))
        ordered = sorted(mine, key=lambda r: r.row_id)
        assert [r.split for r in ordered] == sorted((r.split for r in mine), key=["train", "val", "test"].index)
    assert got == expected


def test_lookup_rules(spark):
    reviews = spark.createDataFrame([(0, "a", "p", "u", 5.0), (1, "b", "p", "u", 1.0), (2, "z", "y", "v", 3.0),
                                     (3, "a", "p", None, 3.0)],
                                    "row_id long, asin string, parent_asin string, user_id string, rating double")
    meta = spark.createDataFrame([(0, "a", 2.0), (1, "a", 4.0), (2, "p", 3.0), (3, "b", 0.0), (4, "z", None),
                                  (5, "other", 1.0)], "row_id long, parent_asin string, average_rating double")
    lookup = enrich.product_lookup(reviews, meta)
    assert {r.parent_asin: r.average_rating for r in lookup.collect()} == {"a": 4.0, "p": 3.0}
    out = {r.row_id: (r.rating_vs_product_avg_abs, r.reviewer_review_count) for r in enrich.enrich(reviews, lookup).collect()}
    assert out == {0: (1.0, 2), 1: (2.0, 2)}  # no product for row 2, no user for row 3
    cover = enrich.enrichment_coverage(reviews, lookup).first()
    assert (cover.matched_reviews, cover.coverage_pct) == (3, 40.0)
    with pytest.raises(enrich.EmptyLookupError):
        enrich.check_lookup(lookup.where("false"))


def test_without_user_column_nothing_is_kept(spark):
    reviews = spark.createDataFrame([(0, "a", 5.0)], "row_id long, asin string, rating double")
    lookup = spark.createDataFrame([("a", 2.0, 1)], "parent_asin string, average_rating double, refs long")
    assert enrich.enrich(reviews, lookup).count() == 0


def test_full_row_repeats_by_digest(spark):
    from reviewsift.operators import dedup
    rows = [(1, "a", None, 0.0, [1], b"x"), (2, "a", None, -0.0, [1], b"x"), (3, None, "a", 0.0, [1], b"x"), (4, "a", "", 0.0, [1], b"x"),
            (5, "a", None, 0.0, [1, 1], b"x"), (6, "a", None, 0.0, [1], b"y"), (7, "1:a", "-", float("nan"), None, None), (8, "1:a", "-", float("nan"), None, None),
            (9, None, None, None, None, None), (10, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "row_id long, s string, t string, d double, a array<int>, b binary")
    assert sorted(r.row_id for r in dedup.drop_duplicate_rows(df).collect()) == [1, 3, 4, 5, 6, 7, 9]
    plan = dedup.drop_duplicate_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(s" not in plan and "HashAggregate(keys=[s" not in plan


def test_likely_members_keeps_all_members_and_few_others(spark):
    from pyspark.sql import functions as F

    from reviewsift.operators.ordering import likely_members
    from reviewsift.session import materialize
    rows = spark.range(200_000).select((F.col("id") * 7919).alias("row_id"), F.lit("x").alias("text"))
    rows = rows.unionByName(rows.where("row_id < 7919")).unionByName(spark.sql("select cast(null as long) row_id, 'n' text"))
    members = materialize(rows.where("row_id % 10 = 0").select("row_id").distinct(), "members")
    found = likely_members(rows, "row_id", members)
    assert found.columns == rows.columns and found.join(members, "row_id").count() == 20_001
    assert found.count() < 20_001 + 180_000 // 8


def test_reject_counts_equal_the_reasons_of_the_rows(spark):
    faults = [{}, {"title": None}, {"text": "<br/>"}, {"text": " "}, {"text": "​<a>\x00", "rating": "9"}, {"rating": "six", "text": "< \t"},
              {"helpful_vote": "-1"}, {"timestamp": 0}, {"asin": " ", "title": "<p>"}, {"user_id": "\t"}, {"text": "w " * 600},
              {"text": "<b>" * 20000 + "x"}, {"text": "​" * 50000, "asin": ""}]
    rows = raw(spark, *faults)
    expected = {}
    for r in validate.check_reviews(rows).collect():
        expected[r.reject_reason or "valid"] = expected.get(r.reject_reason or "valid", 0) + 1
    assert {r.reject_reason: r.n for r in validate.reject_counts(rows).collect()} == expected
    assert validate.valid_reviews(rows).count() == expected["valid"]


def test_rejected_rows_are_not_cleaned(spark):
    """The filter on the other columns stands below the cleaning, so it runs first."""
    plan = validate.valid_reviews(raw(spark, {}))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("try_cast(rating") > plan.rindex("Generate")
