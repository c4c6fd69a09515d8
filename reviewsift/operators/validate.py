"""Row validation: one pass, the reason of each rejection kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsift.functions.text import clean_text, cleans_to_nothing, computed_once, compose_review_data, piece_count, strip
from reviewsift.schemas import DATASET_COLUMNS, require_columns

REQUIRED = ["title", "text", "rating", "asin", "parent_asin", "user_id", "timestamp",
            "verified_purchase", "helpful_vote"]
MAX_TOKENS = 512


def has_images(images: Column | str) -> Column:
    return F.coalesce(F.size(images) > 0, F.lit(False))


def _reject_early(empty: Column) -> Column:
    """Reason of a rejection that the raw columns show; ``empty`` tells of a text that cleaning leaves empty."""
    missing = F.lit(False)
    for c in REQUIRED:
        missing = missing | F.col(c).isNull()
    rating, votes = F.expr("try_cast(rating as double)"), F.expr(VOTES)
    blank_id = F.lit(False)
    for c in ("asin", "parent_asin", "user_id"):
        blank_id = blank_id | (strip(F.col(c).cast("string")) == "")
    return (
        F.when(missing, "missing_field")
        .when(empty, "empty_text")
        .when(~F.coalesce(rating.between(1.0, 5.0), F.lit(False)), "bad_rating")
        .when(~F.coalesce(votes >= 0, F.lit(False)), "bad_helpful_vote")
        .when(F.col("timestamp") == 0, "bad_timestamp")
        .when(blank_id, "blank_id")
    )


VOTES = "try_cast(try_cast(helpful_vote as double) as bigint)"


def check_reviews(raw: DataFrame, max_tokens: int = MAX_TOKENS, token_count=piece_count) -> DataFrame:
    """All rows, cleaned and typed, with ``reject_reason`` (null for a valid row).

    Checks run in a fixed order and the first failure names the reason. ``token_count`` maps
    the composed text column to its number of tokens.
    """
    require_columns(raw, [*REQUIRED, "category", "images"], "check_reviews")
    early = _reject_early(F.lit(False))
    typed = computed_once(raw.withColumn("_raw", early), title=clean_text("title"), text=clean_text("text"))
    typed = (
        typed.withColumn("rating", F.expr("try_cast(rating as double)"))
        .withColumn("helpful_vote", F.expr(VOTES))
        .withColumns({c: strip(F.col(c).cast("string")) for c in ("asin", "parent_asin", "user_id")})
        .withColumn("has_images", has_images("images"))
        .withColumn("review_data", compose_review_data("category", "title", "text"))
    )
    empty = (F.col("title") == "") | (F.col("text") == "")
    reason = F.when(F.col("_raw") == "missing_field", F.col("_raw")).when(empty, "empty_text").otherwise(F.col("_raw"))
    # the costly count comes last, for rows that nothing else rejects (null for the others)
    typed = computed_once(typed.withColumn("_early", reason), token_count=F.when(
        F.col("_early").isNull(), token_count("review_data").cast("int")))
    late = F.coalesce("_early", F.when(F.col("token_count") > max_tokens, F.lit("too_long")))
    return typed.withColumn("reject_reason", late).drop("_raw", "_early", "images")


def valid_reviews(raw: DataFrame, **options) -> DataFrame:
    """Rows that pass every check, as ``row_id`` and the 13 dataset columns.

    Texts are cleaned only where the other columns are right, as no order of reasons is asked for.
    """
    require_columns(raw, [*REQUIRED, "category", "images"], "check_reviews")
    checked = check_reviews(raw.where(_reject_early(F.lit(False)).isNull()), **options)
    return checked.where(F.col("reject_reason").isNull()).select("row_id", *DATASET_COLUMNS)


def reject_counts(raw: DataFrame, max_tokens: int = MAX_TOKENS, token_count=piece_count) -> DataFrame:
    """Rows per reason of ``check_reviews``. Texts are cleaned only where nothing else rejects the row."""
    require_columns(raw, [*REQUIRED, "category", "images"], "check_reviews")
    known = computed_once(raw, _early=_reject_early(cleans_to_nothing("title") | cleans_to_nothing("text")))
    count = token_count(compose_review_data("category", clean_text("title"), clean_text("text")))
    late = F.when(F.col("_early").isNotNull(), F.col("_early")).when(count > max_tokens, "too_long").otherwise("valid")
    return known.groupBy(late.alias("reject_reason")).agg(F.count("*").alias("n"))


def complete_rows(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Rows without any null, optionally the first ``max_rows`` by row id (0 means all)."""
    full = df.na.drop("any")
    return full.orderBy("row_id").limit(max_rows) if max_rows else full


def take_first(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("row_id").limit(n)
