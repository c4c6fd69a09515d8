"""Declared schemas and column groups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RAW_REVIEW = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("rating", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("images", T.ArrayType(T.StructType([
        T.StructField("small_image_url", T.StringType()),
    ]))),
    T.StructField("asin", T.StringType()),
    T.StructField("parent_asin", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("verified_purchase", T.BooleanType()),
    T.StructField("helpful_vote", T.StringType()),
])

RAW_META = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("parent_asin", T.StringType()),
    T.StructField("average_rating", T.DoubleType()),
])

# The 13 columns of the built dataset.
DATASET_COLUMNS = [
    "review_data", "rating", "token_count", "category", "title", "text", "has_images",
    "asin", "parent_asin", "user_id", "timestamp", "verified_purchase", "helpful_vote",
]

# Feature order is fixed: squared distances are summed in this order.
FEATURES = [
    "helpful_vote", "verified_purchase", "has_images",
    "rating_diff", "reviewer_review_count", "rating_vs_product_avg_abs",
]
FLAG_FEATURES = ["verified_purchase", "has_images"]

# The review categories the loader knows.
CATEGORIES = [
    "Automotive", "Books", "Clothing_Shoes_and_Jewelry", "Electronics",
    "Grocery_and_Gourmet_Food", "Home_and_Kitchen", "Musical_Instruments",
    "Sports_and_Outdoors", "Tools_and_Home_Improvement", "Unknown",
]


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} needs columns {missing}, found {df.columns}")
