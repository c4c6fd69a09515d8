"""File sources: reviews and metadata by category, CSV tables, folders of files."""

from __future__ import annotations

import re
import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewsift.operators.dedup import row_digest
from reviewsift.operators.ordering import without_ids
from reviewsift.operators.sketches import REGISTERS
from reviewsift.operators.validate import complete_rows, take_first
from reviewsift.schemas import CATEGORIES, RAW_META, RAW_REVIEW
from reviewsift.session import materialize
from reviewsift.sources.csv_records import read_by_header, read_records


def _by_category(spark: SparkSession, path: str, schema: T.StructType, category: str | None,
                 fmt: str, n: int | None) -> DataFrame:
    if not category:
        raise ValueError("a category is required")
    if category not in CATEGORIES:
        warnings.warn(f"category {category!r} is not among the known ones", stacklevel=3)
    df = spark.read.schema(schema).format(fmt).load(path).where(F.col("category") == category)
    return take_first(df, n) if n else df


def read_reviews(spark: SparkSession, path: str, category: str | None, fmt: str = "parquet",
                 num_samples: int | None = None) -> DataFrame:
    """Reviews of one category from a folder partitioned by ``category`` (pruned by Spark).

    ``num_samples`` takes the first rows by id, before any filter.
    """
    return _by_category(spark, path, RAW_REVIEW, category, fmt, num_samples)


def read_metadata(spark: SparkSession, path: str, category: str | None, fmt: str = "parquet",
                  num_samples: int | None = None) -> DataFrame:
    """Product metadata of one category, reduced to the columns that are used."""
    return _by_category(spark, path, RAW_META, category, fmt, num_samples)


def invalid_categories(requested: DataFrame, known: DataFrame) -> DataFrame:
    """Requested category names that are not known."""
    return requested.select("category").distinct().join(known.select("category").distinct(), "category", "left_anti")


def check_categories(spark: SparkSession, requested: list[str]) -> None:
    bad = sorted(set(requested) - set(CATEGORIES))
    if bad:
        raise ValueError(f"unknown categories: {bad}")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, max_rows: int | None = None,
             null_token: str = "") -> DataFrame:
    """CSV with a header and quoted multi-line fields; rows with any null are dropped.

    One file is read by as many tasks as it has chunks (see ``csv_records``).
    """
    return complete_rows(read_records(spark, path, schema, null_token), max_rows)


def _files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Paths of the files below a folder by name (Spark lists them; no content is read)."""
    return spark.read.format("binaryFile").options(
        pathGlobFilter=f"*{suffix}", recursiveFileLookup="true").load(folder).select("path")


def combine_folder(spark: SparkSession, folder: str, use_parquet: bool = True, source_in_key: bool = False,
                   skip_unreadable: bool = False) -> DataFrame | None:
    """All Parquet files of a folder, else all CSV files, with ``source_file``; full-row duplicates out.

    Files are read by the columns they name, in any order, and missing columns become null; CSV values are strings.
    ``source_file`` is the file's (or the written folder's) name below ``folder``. None where there are no files.
    A file that cannot be opened is an error, or, with ``skip_unreadable``, is named in a warning and left out.
    By default the file name is no part of the duplicate key and the least one is kept.

    The schemas are found by tasks: the footers by Spark's schema merge, the headers as a table of their own. The
    number of jobs does not depend on the number of files.
    """
    root = folder.rstrip("/")
    place = F.regexp_extract(F.col("file"), f"/{re.escape(root.rsplit('/', 1)[-1])}/([^/]+)", 1)
    if use_parquet and not _files(spark, root, ".parquet").isEmpty():
        rows = _combined_parquet(spark, root, skip_unreadable)
    elif not _files(spark, root, ".csv").isEmpty():
        rows = read_by_header(spark, root, place=_AT, pathGlobFilter="*.csv", recursiveFileLookup="true")
    else:
        return None
    if rows is None or not set(rows.columns) - {"file", _AT}:
        return None
    rows = rows.withColumns({"source_file": place, _AT: F.struct("file", _AT)}).drop("file")
    return _without_repeats(rows, source_in_key)


_AT = "_row_in_file"
_BELOW = {"pathGlobFilter": "*.parquet", "recursiveFileLookup": "true"}


def _combined_parquet(spark: SparkSession, root: str, skip_unreadable: bool) -> DataFrame | None:
    """Rows of all Parquet files below ``root`` by column name, with ``file`` and the row's place in it."""
    named = lambda df: df.withColumns({"file": F.col("_metadata.file_path"), _AT: F.col("_metadata.row_index")})
    try:
        return named(spark.read.options(**_BELOW, mergeSchema="true").parquet(root))
    except Exception:  # a file that is none, or one column of several types: look at the files one by one
        by_columns: dict[str, list[str]] = {}
        skipped = []
        for f in (r.path for r in _files(spark, root, ".parquet").orderBy("path").collect()):
            try:
                by_columns.setdefault(spark.read.parquet(f).schema.json(), []).append(f)
            except Exception:
                if not skip_unreadable:
                    raise
                skipped.append(f)
        if skipped:
            warnings.warn(f"unreadable files left out: {skipped}", stacklevel=3)
        tables = [named(spark.read.parquet(*paths)) for paths in by_columns.values()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables) if tables else None


def combine(tables: list[DataFrame], source_in_key: bool = False) -> DataFrame:
    """Union by name (missing columns become null) and full-row dedup."""
    merged = tables[0]
    for t in tables[1:]:
        merged = merged.unionByName(t, allowMissingColumns=True)
    return drop_file_duplicates(merged, source_in_key)


def drop_file_duplicates(df: DataFrame, source_in_key: bool) -> DataFrame:
    if source_in_key:
        return df.dropDuplicates()
    keys = [c for c in df.columns if c != "source_file"]
    # digests are the keys; equal rows are one value that each task keeps once
    return df.groupBy(row_digest(df, keys).alias("_digest")).agg(
        F.first(F.struct(*[F.col(f"`{c}`") for c in keys])).alias("_row"), F.min("source_file").alias("source_file")
    ).select("_row.*", "source_file")


def _without_repeats(rows: DataFrame, source_in_key: bool) -> DataFrame:
    """``drop_file_duplicates`` of rows read from files. Rows are compared by digests and known by their place in
    the files, so the wide rows are not shuffled: they meet the places of repeats where they are (see ``without_ids``).
    """
    keys = [c for c in rows.columns if c != _AT and (source_in_key or c != "source_file")]
    marked = materialize(rows.select(_AT, "source_file", F.unhex(row_digest(rows, keys)).alias("digest")), "digests")
    first = materialize(marked.groupBy("digest").agg(
        F.min(F.struct("source_file", _AT))[_AT].alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1").select("digest", "_first"), "repeated")
    repeats = materialize(marked.join(first, "digest").where(F.col(_AT) != F.col("_first")).select(_AT), "repeats")
    return without_ids(rows, _AT, repeats, marked).drop(_AT)


def dataset_profile(reviews: DataFrame, approx: bool = False) -> DataFrame:
    """Totals of a review table: rows, distinct users and products, time span.

    ``approx`` counts the distinct values by sketches (see ``operators.sketches``), in one pass that shuffles a few
    kilobytes a task; the exact way shuffles each task's distinct values.
    """
    span = [F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp")]
    if approx:
        distinct = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), F.lit(REGISTERS)))
    else:
        distinct = F.countDistinct
    return reviews.agg(F.count("*").alias("total_reviews"), distinct("user_id").alias("total_users"),
                       distinct("asin").alias("total_items"), *span)
