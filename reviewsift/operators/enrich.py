"""Join product averages and reviewer activity onto scored reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsift.operators.ordering import join_hot
from reviewsift.schemas import require_columns
from reviewsift.session import materialize


class EmptyLookupError(ValueError):
    """No product of the reviews was found in the metadata."""


def _product_rows(reviews: DataFrame) -> DataFrame:
    """Every product id of the reviews with the number of times it is referred to."""
    return (
        reviews.select(F.explode(F.array("asin", "parent_asin")).alias("product_id"))
        .where(F.col("product_id").isNotNull())
        .groupBy("product_id").agg(F.count("*").alias("refs"))
    )


def product_ids(reviews: DataFrame) -> DataFrame:
    """Distinct product ids: asin and parent_asin together, nulls out."""
    return _product_rows(reviews).select("product_id")


def product_lookup(reviews: DataFrame, meta: DataFrame) -> DataFrame:
    """One average rating per product that occurs in the reviews; the last metadata row wins.

    Stored once: ``(parent_asin, average_rating, refs)``, where ``refs`` counts the references
    and lets the joins on it see hot products.
    """
    require_columns(meta, ["row_id", "parent_asin", "average_rating"], "product_lookup")
    averages = (
        meta.where(F.col("average_rating").isNotNull() & (F.col("average_rating") != 0))
        .groupBy("parent_asin")
        .agg(F.max_by("average_rating", "row_id").alias("average_rating"))
    )
    ids = _product_rows(reviews).withColumnRenamed("product_id", "parent_asin")
    return materialize(averages.join(ids, "parent_asin"), "lookup")


def check_lookup(lookup: DataFrame) -> None:
    if lookup.isEmpty():
        raise EmptyLookupError("no product of the reviews has a rating in the metadata")


def reviews_per_user(reviews: DataFrame) -> DataFrame:
    return (
        reviews.where(F.col("user_id").isNotNull())
        .groupBy("user_id").agg(F.count("*").alias("reviewer_review_count"))
    )


def _with_average(reviews: DataFrame, lookup: DataFrame, key: str, out: str) -> DataFrame:
    """Left join of the lookup on ``key``."""
    renamed = lookup.select(F.col("parent_asin").alias(key), F.col("average_rating").alias(out), "refs")
    return join_hot(reviews, renamed, [key], "refs", "row_id").drop("refs")


def match_products(reviews: DataFrame, lookup: DataFrame) -> DataFrame:
    """Add ``product_avg``: the average found by asin, else by parent_asin."""
    require_columns(reviews, ["row_id", "asin", "rating"], "match_products")
    matched = _with_average(reviews, lookup, "asin", "_by_asin")
    if "parent_asin" not in reviews.columns:
        return matched.withColumnRenamed("_by_asin", "product_avg")
    return (
        _with_average(matched, lookup, "parent_asin", "_by_parent")
        .withColumn("product_avg", F.coalesce("_by_asin", "_by_parent"))
        .drop("_by_asin", "_by_parent")
    )


def with_user_counts(reviews: DataFrame) -> DataFrame:
    if "user_id" not in reviews.columns:
        return reviews.withColumn("reviewer_review_count", F.lit(None).cast("bigint"))
    counts = materialize(reviews_per_user(reviews), "user_counts")
    return join_hot(reviews, counts, ["user_id"], "reviewer_review_count", "row_id")


def enrich(reviews: DataFrame, lookup: DataFrame) -> DataFrame:
    """Reviews with rating deviation and reviewer activity; unmatched rows are dropped.

    User counts are taken before the drop. Call ``check_lookup`` first where an empty lookup
    should stop the job. The joins see ids and ratings only; the wide rows meet their two values once, by
    ``row_id``. Rows without a user or a product id match nothing and leave before the joins.
    """
    keys = [c for c in ("asin", "parent_asin", "user_id") if c in reviews.columns]
    ids = reviews.select("row_id", "rating", *keys).where(F.coalesce(*[F.col(k).cast("string") for k in keys if k != "user_id"]).isNotNull())
    if "user_id" in keys:
        counts = materialize(reviews_per_user(reviews), "user_counts")
        ids = join_hot(ids.where(F.col("user_id").isNotNull()), counts, ["user_id"], "reviewer_review_count", "row_id")
    else:
        ids = ids.withColumn("reviewer_review_count", F.lit(None).cast("bigint"))
    found = (
        match_products(ids, lookup)
        .withColumn("rating_vs_product_avg_abs", F.abs(F.col("rating") - F.col("product_avg")))
        .na.drop(subset=["rating_vs_product_avg_abs", "reviewer_review_count"])
        .select("row_id", "reviewer_review_count", "rating_vs_product_avg_abs")
    )
    return reviews.join(found, "row_id")


def enrichment_stats(enriched: DataFrame) -> DataFrame:
    dev, cnt = F.col("rating_vs_product_avg_abs"), F.col("reviewer_review_count")
    return enriched.agg(
        F.avg(dev).alias("mean_abs_deviation"),
        F.max(dev).alias("max_abs_deviation"),
        F.min(dev).alias("min_abs_deviation"),
        F.avg(cnt).alias("mean_reviews_per_user"),
        F.min(cnt).alias("min_reviews_per_user"),
        F.max(cnt).alias("max_reviews_per_user"),
        F.count_if(cnt == 1).alias("users_with_1_review"),
        F.count_if(cnt > 10).alias("users_with_over_10_reviews"),
        F.count_if(dev.isNull()).alias("missing_deviation"),
    )


def enrichment_coverage(reviews: DataFrame, lookup: DataFrame) -> DataFrame:
    """Matched reviews and share, and the share of distinct product ids the lookup covers."""
    found = product_ids(reviews).join(
        lookup.select(F.col("parent_asin").alias("product_id"), F.lit(1).alias("_hit")),
        "product_id", "left",
    ).agg(F.struct(F.count("*").alias("ids"), F.count("_hit").alias("hits"))).scalar()
    return match_products(reviews, lookup).agg(
        F.count("*").alias("reviews"),
        F.count("product_avg").alias("matched_reviews"),
        F.try_divide(F.count("product_avg") * 100.0, F.count("*")).alias("match_pct"),
        F.try_divide(F.first(found["hits"]) * 100.0, F.first(found["ids"])).alias("coverage_pct"),
    )
