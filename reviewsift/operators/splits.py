"""Positional train/val/test splits per category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsift.operators.ordering import small, with_position
from reviewsift.session import materialize


def split_limits(df: DataFrame, train_n: int, val_n: int, test_n: int) -> DataFrame:
    """Per category, the first row id behind each split (null where the category ends earlier)."""
    placed = with_position(df.select("category", "row_id"), [F.asc("row_id")], within=["category"])
    at = lambda n: F.max(F.when(F.col("pos") == n, F.col("row_id")))
    return placed.groupBy("category").agg(
        at(train_n).alias("_train_end"),
        at(train_n + val_n).alias("_val_end"),
        at(train_n + val_n + test_n).alias("_test_end"),
    )


def split_dataset(df: DataFrame, train_n: int, val_n: int, test_n: int) -> DataFrame:
    """Add ``split``: the first ``train_n`` rows of each category, the next ``val_n``, then
    ``test_n``; the rest is dropped.

    Only ids are sorted; the wide rows are compared with three ids per category.
    """
    # one row per category: the wide rows are not shuffled for it
    return split_by(df, small(materialize(split_limits(df, train_n, val_n, test_n), "split_limits")))


def split_by(df: DataFrame, limits: DataFrame) -> DataFrame:
    """Add ``split`` by the ``limits`` of each category (see ``split_limits``); rows behind the last are dropped."""
    before = lambda end: F.col(end).isNull() | (F.col("row_id") < F.col(end))
    split = (
        F.when(before("_train_end"), "train").when(before("_val_end"), "val")
        .when(before("_test_end"), "test")
    )
    return (
        df.join(limits, "category").withColumn("split", split)
        .where(F.col("split").isNotNull())
        .drop("_train_end", "_val_end", "_test_end")
    )
