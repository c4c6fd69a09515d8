"""Duplicate removal that keeps the first row, and anti-joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsift.operators.ordering import without_ids
from reviewsift.session import materialize


def first_of_each(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row with the least ``row_id`` per key, whole rows kept.

    Copies collapse before the shuffle (a grouped minimum), so a text that makes up a third
    of the table costs one row per task; the kept ids then select the rows.
    """
    kept = df.groupBy(*keys).agg(F.min("row_id").alias("row_id")).select("row_id")
    return df.join(kept, "row_id", "left_semi")


def row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of the columns' values; rows have the same digest exactly if they are equal (null equals null)."""
    kinds = dict(df.dtypes)

    def part(name: str) -> Column:
        kind, value = kinds[name], F.col(f"`{name}`")
        if kind.startswith(("array", "struct", "map")):
            value = F.to_json(F.struct(value))
        elif kind == "binary":
            value = F.base64(value)
        elif kind in ("double", "float"):
            value = (value + F.lit(0.0).cast(kind)).cast("string")  # both zeros are one
        else:
            value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(F.lit(""), *map(part, columns)), 256)


def repeated_ids(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``row_id`` of the rows of ``marked(row_id, *keys)``, a stored narrow table, that repeat an earlier one."""
    groups = materialize(
        marked.groupBy(*keys).agg(F.min("row_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1").withColumnsRenamed({k: f"_{k}_of" for k in keys}), "repeated")
    same = reduce(Column.__and__, [marked[k].eqNullSafe(groups[f"_{k}_of"]) for k in keys])
    return materialize(marked.join(groups, same).where("row_id > _first").select("row_id"), "repeats")


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Full-row duplicates out (all columns but ``row_id``), first kept. Rows are compared by their digests, so
    no text is a shuffle key, and only the ids of repeats meet the wide rows, which are not shuffled.
    """
    columns = [c for c in df.columns if c != "row_id"]
    marked = materialize(df.select("row_id", row_digest(df, columns).alias("digest")), "digests")
    return without_ids(df, "row_id", repeated_ids(marked, ["digest"]), marked)


def drop_duplicate_reviews(df: DataFrame) -> DataFrame:
    """First row of each text and rating. Texts are compared by their SHA-256 digests, so no text is a shuffle
    key; the wide rows are compared with the ids of repeats, however many, where they are (see ``without_ids``).
    """
    marked = materialize(df.select("row_id", "rating", F.sha2("review_data", 256).alias("digest")), "digests")
    return without_ids(df, "row_id", repeated_ids(marked, ["digest", "rating"]), marked)


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    groups = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_before"),
        F.count("*").alias("rows_after"),
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count("*")).alias("removed"),
    )


def normal_reviews(original: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Original rows that are not anomalies, by row id."""
    return original.join(anomalies.select("row_id"), "row_id", "left_anti")
