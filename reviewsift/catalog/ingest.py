"""Queries on raw and cleaned reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewsift import fixtures as fx
from reviewsift.catalog.base import (
    CHECKED, NON_SPACES, RAW, REVIEWS, clean_sql, on_enriched, r, rounded, with_views,
)
from reviewsift.functions.text import (
    category_from_path, category_slug, clean_text, computed_once, first_pieces, piece_count, word_count)
from reviewsift.operators import dedup, sketches, splits, validate
from reviewsift.plans.dataset import build_dataset
from reviewsift.session import materialize, scratch_path
from reviewsift.sources import readers, sinks
from reviewsift.streaming.ingest import start_validated_ingest
from reviewsift.streaming.quota import read_ingested, start_quota_ingest

RAW_COLUMNS = ["row_id", "category", "rating", "title", "asin", "user_id", "helpful_vote"]
BUILT = ["row_id", "split", "review_data", "rating", "token_count", "category", "title", "text", "has_images",
         "asin", "parent_asin", "user_id", "timestamp", "verified_purchase", "helpful_vote"]


def sizes(spark, sf) -> dict[str, int]:
    """Split sizes that together hold the largest category, so every row is in a split."""
    largest = fx.reviews(spark, sf).groupBy("category").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    train, val = largest // 16, largest // 32
    return {"train_n": train, "val_n": val, "test_n": largest - train - val}


def scan_reviews(spark, sf):
    path = scratch_path(spark, "raw_by_category")
    fx.raw_reviews(spark, sf).write.partitionBy("category").parquet(path)
    return readers.read_reviews(spark, path, "en").select(*RAW_COLUMNS)


def scan_metadata(spark, sf):
    path = scratch_path(spark, "meta_by_category")
    fx.product_meta(spark, sf).withColumn("category", F.lit("Unknown")).withColumn(
        "parent_asin", F.col("parent_asin").cast("string")).write.partitionBy("category").parquet(path)
    return rounded(readers.read_metadata(spark, path, "Unknown").select("parent_asin", "average_rating"))


def take_first_n(spark, sf):
    return rounded(validate.take_first(fx.reviews(spark, sf), 500).select("row_id", "user_id", "rating", "title"))


def invalid_categories(spark, sf):
    known = fx.table(spark, sf, "documents").where("source is not null").select(F.col("lang").alias("category"))
    requested = fx.table(spark, sf, "documents").select(F.explode(F.array(
        "lang", F.concat("lang", F.lit("_"), "source"))).alias("category"))
    return readers.invalid_categories(requested, known)


def dataset_profile(spark, sf):
    return readers.dataset_profile(fx.scored_reviews(spark, sf))


def profile_sketches(spark, sf):
    """Distinct values of all reviews from one sketch per rating, beside the exact counts, and whether the quantiles
    of the predicted rating have ranks within the sketch's bound."""
    reviews = materialize(fx.scored_reviews(spark, sf).select("rating", "user_id", "asin", "predicted_rating"), "profiled")
    kept = materialize(sketches.slice_sketches(reviews, ["rating"], ["user_id", "asin"], ["predicted_rating"]), "sketches")
    found = sketches.sketch_profile(sketches.merge_sketches(kept), [0.25, 0.5, 0.75]).first()  # one row
    near = lambda c: F.abs(F.col(c) - F.lit(found[f"distinct_{c}"])) <= 4 * sketches.distinct_error() * F.col(c)
    value, ranked = F.col("predicted_rating"), []
    for q, at in zip((0.25, 0.5, 0.75), found["quantiles_predicted_rating"]):
        ranked += [F.avg((value < at).cast("double")) <= q + sketches.RANK_ERROR, F.avg((value <= at).cast("double")) >= q - sketches.RANK_ERROR]
    exact = reviews.agg(F.count("*").alias("rows"), F.countDistinct("user_id").alias("user_id"), F.countDistinct("asin").alias("asin"),
                        reduce(Column.__and__, ranked).alias("quantiles_within"))
    return exact.select("rows", F.col("user_id").alias("users"), F.col("asin").alias("items"), near("user_id").alias("users_within"),
                        near("asin").alias("items_within"), "quantiles_within")


def truncate_tokens(spark, sf):
    """What a model of 512 tokens reads of each document."""
    docs = fx.spread(fx.table(spark, sf, "documents"), "doc_id")
    cut = computed_once(docs.select("doc_id", "text"), head=first_pieces("text", validate.MAX_TOKENS - 2))
    return cut.select("doc_id", F.length("head").cast("bigint").alias("chars"), F.md5("head").alias("digest"),
                      piece_count("head").cast("bigint").alias("token_count"))


def save_sample(spark, sf):
    path = scratch_path(spark, "sample")
    sinks.save_sample(fx.raw_reviews(spark, sf), path, 1000, "json")
    return spark.read.json(path).groupBy("category").agg(F.count("*").alias("n"))


def load_complete_rows(spark, sf):
    raw = fx.raw_reviews(spark, sf).select(*RAW_COLUMNS)
    path = scratch_path(spark, "csv")
    sinks.csv_writer(raw).csv(path)
    return readers.read_csv(spark, path, raw.schema)


def write_splits(spark, sf):
    path = scratch_path(spark, "splits")
    sinks.write_splits(build_dataset(fx.raw_reviews(spark, sf), **sizes(spark, sf)), path)
    return spark.read.parquet(f"{path}/parquet").groupBy("split", "category_name").agg(F.count("*").alias("n"))


def category_slugs(spark, sf):
    parts = fx.table(spark, sf, "part")
    name = F.concat("p_name", F.lit(" & "), "p_brand")
    return parts.select("p_partkey", category_slug(name).alias("slug"))


def category_paths(spark, sf):
    parts = fx.table(spark, sf, "part")
    suffix = F.element_at(F.array(F.lit("_test"), F.lit("_train"), F.lit("_val"), F.lit("")),
                          (F.col("p_partkey") % 4 + 1).cast("int"))
    name = F.concat_ws("-", "p_name", F.concat("p_size", F.lit("d")), "p_type")
    path = F.concat(F.lit("/data/"), F.replace(name, F.lit(" "), F.lit("_")), suffix, F.lit(".csv"))
    return parts.select("p_partkey", category_from_path(path).alias("category"))


def combine_sources(spark, sf):
    """Folders of Parquet and of CSV files, whose columns differ in order and number, read back as one table."""
    folder = scratch_path(spark, "combine")
    docs, pages = fx.table(spark, sf, "documents"), fx.table(spark, sf, "pages")
    docs.select("text", "lang", "source").write.parquet(f"{folder}/columnar/a.parquet")
    docs.select("source", "text", "lang").write.parquet(f"{folder}/columnar/b.parquet")  # adds no row
    pages.select("url", F.col("html").alias("text")).write.parquet(f"{folder}/columnar/c.parquet")
    rows = [F.col(c).cast("string").alias(c) for c in ("doc_id", "lang", "text")]
    sinks.csv_writer(docs.select(*rows)).csv(f"{folder}/rows/d.csv")
    sinks.csv_writer(docs.select(rows[2], rows[0], "source", rows[1])).csv(f"{folder}/rows/e.csv")
    tables = [readers.combine_folder(spark, f"{folder}/columnar"),
              readers.combine_folder(spark, f"{folder}/rows", use_parquet=False, source_in_key=True)]
    return tables[0].unionByName(tables[1], allowMissingColumns=True)


def clean_texts(spark, sf):
    return fx.spread(fx.table(spark, sf, "pages"), "page_id").select("page_id", clean_text("html").alias("cleaned"))


def validate_reviews(spark, sf):
    return rounded(validate.valid_reviews(fx.raw_reviews(spark, sf)))


def has_images(spark, sf):
    return fx.raw_reviews(spark, sf).select("row_id", validate.has_images("images").alias("has_images"))


def review_data(spark, sf):
    return fx.reviews(spark, sf).select("row_id", "review_data")


def filter_token_count(spark, sf):
    docs = fx.spread(fx.table(spark, sf, "documents"), "doc_id")
    return docs.select("doc_id", piece_count("text").cast("bigint").alias("token_count")).where(
        F.col("token_count") <= validate.MAX_TOKENS)


def reject_counts(spark, sf):
    return validate.reject_counts(fx.raw_reviews(spark, sf))


def word_counts(spark, sf):
    return fx.spread(fx.table(spark, sf, "documents"), "doc_id").select("doc_id", word_count("text").cast("bigint").alias("words"))


def _documents(spark, sf):
    return fx.table(spark, sf, "documents").withColumnRenamed("doc_id", "row_id")


def dedup_full_row(spark, sf):
    return dedup.drop_duplicate_rows(_documents(spark, sf))


def dedup_review_rating(spark, sf):
    return rounded(dedup.drop_duplicate_reviews(
        fx.reviews(spark, sf).select("row_id", "review_data", "rating", "user_id")))


def dedup_counts(spark, sf):
    return dedup.duplicate_counts(fx.reviews(spark, sf), ["review_data", "rating"])


def split_dataset(spark, sf):
    return splits.split_dataset(fx.reviews(spark, sf), **sizes(spark, sf)).select("row_id", "category", "split")


def built_dataset(spark, sf):
    return rounded(build_dataset(fx.raw_reviews(spark, sf), **sizes(spark, sf)).select(*BUILT))


def _arrive(raw, source) -> None:
    """Add rows to a stream's folder. A compressed file is read by one task, so its rows are bounded."""
    raw.write.mode("append").options(**{"maxRecordsPerFile": 50_000, "zlib.compress.level": "BEST_SPEED"}).json(
        source, compression="gzip")


def stream_validate(spark, sf):
    source, target, state = (scratch_path(spark, n) for n in ("stream_in", "stream_out", "stream_state"))
    _arrive(fx.raw_reviews(spark, sf), source)
    start_validated_ingest(spark, source, target, state).awaitTermination()
    return rounded(spark.read.parquet(target))


STREAM_QUOTA = 1000


def stream_quota(spark, sf):
    """Files arrive in three parts, each read by a run of its own."""
    source, target, state = (scratch_path(spark, n) for n in ("quota_in", "quota_out", "quota_state"))
    raw = materialize(fx.raw_reviews(spark, sf), "quota_raw")
    top = raw.agg(F.max("row_id")).first()[0] or 0
    for part in range(3):
        _arrive(raw.where(F.expr(f"row_id * 3 div {top + 1} = {part}")), source)
        start_quota_ingest(spark, source, target, state, STREAM_QUOTA).awaitTermination()
    return rounded(read_ingested(spark, target).select(*[c for c in BUILT if c != "split"]))


QUERIES = {
    "scan_reviews": scan_reviews, "scan_metadata": scan_metadata, "take_first_n": take_first_n,
    "invalid_categories": invalid_categories, "dataset_profile": dataset_profile, "save_sample": save_sample,
    "load_complete_rows": load_complete_rows, "write_splits": write_splits, "category_slug": category_slugs,
    "category_from_path": category_paths, "combine_sources": combine_sources, "clean_text": clean_texts,
    "validate_reviews": validate_reviews, "has_images": has_images, "compose_review_data": review_data,
    "filter_token_count": filter_token_count, "reject_counts": reject_counts, "word_count": word_counts,
    "dedup_full_row": dedup_full_row, "dedup_review_rating": dedup_review_rating, "dedup_counts": dedup_counts,
    "split_dataset": split_dataset, "build_dataset": built_dataset, "stream_validate": stream_validate,
    "profile_sketches": profile_sketches, "truncate_tokens": truncate_tokens, "stream_quota": stream_quota,
}

_N = "(SELECT max(n) FROM (SELECT count(*) AS n FROM reviews GROUP BY category))"
_SPLIT = f"""CASE WHEN pos <= {_N} // 16 THEN 'train'
  WHEN pos <= {_N} // 16 + {_N} // 32 THEN 'val' ELSE 'test' END"""
_VALID_ROWS = with_views("SELECT * FROM valid", REVIEWS, RAW, CHECKED)

# The raw rows, validated, deduplicated, split; repeats out of train.
_BUILT = f"""
raw AS (SELECT * FROM raw_all),{CHECKED},
distinct_rows AS (
  SELECT min(row_id) AS row_id, * EXCLUDE (row_id) FROM valid GROUP BY ALL
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY row_id) AS pos FROM distinct_rows
),
parts AS (SELECT * EXCLUDE (pos), {_SPLIT} AS split FROM placed),
built AS (
  SELECT * EXCLUDE (k) FROM (
    SELECT *, row_number() OVER (PARTITION BY split, review_data, rating ORDER BY row_id) AS k FROM parts)
  WHERE split <> 'train' OR k = 1
)"""
_RAW_ALL = RAW.replace("raw AS (", "raw_all AS (", 1)
_BUILT_COLUMNS = ", ".join(f'"{c}"' if c != "rating" else r("rating", "rating") for c in BUILT)

_QUOTA_COLUMNS = ", ".join(f'"{c}"' if c != "rating" else r("rating", "rating") for c in BUILT if c != "split")

ORACLES = {
    "scan_reviews": with_views(
        "SELECT row_id, category, rating, title, asin, user_id, helpful_vote FROM raw WHERE category = 'en'", REVIEWS, RAW),
    "scan_metadata": with_views(
        f"SELECT CAST(parent_asin AS VARCHAR) AS parent_asin, {r('average_rating', 'average_rating')} FROM product_meta", REVIEWS),
    "take_first_n": with_views(
        "SELECT row_id, user_id, rating, title FROM reviews ORDER BY row_id LIMIT 500", REVIEWS),
    "invalid_categories": """SELECT DISTINCT category FROM (
        SELECT lang AS category FROM documents UNION ALL SELECT lang || '_' || source FROM documents)
        WHERE category IS NOT NULL AND category NOT IN (SELECT lang FROM documents)""",
    "dataset_profile": with_views(
        """SELECT count(*) AS total_reviews, count(DISTINCT user_id) AS total_users, count(DISTINCT asin) AS total_items,
        min("timestamp") AS first_timestamp, max("timestamp") AS last_timestamp FROM reviews""", REVIEWS),
    "profile_sketches": with_views(
        """SELECT count(*) AS rows, count(DISTINCT user_id) AS users, count(DISTINCT asin) AS items, TRUE AS users_within,
        TRUE AS items_within, TRUE AS quantiles_within FROM reviews""", REVIEWS),
    "truncate_tokens": r"""SELECT doc_id, CAST(length(head) AS BIGINT) AS chars, md5(head) AS digest, CAST(least(len(p), 510) + 2 AS BIGINT) AS token_count
        FROM (SELECT doc_id, p, CASE WHEN len(p) <= 510 THEN text ELSE array_to_string(list_slice(p, 1, 510), '') END AS head
          FROM (SELECT doc_id, text, regexp_extract_all(text, '\s*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])') AS p FROM documents))""",
    "save_sample": with_views(
        "SELECT category, count(*) AS n FROM (SELECT category FROM raw ORDER BY row_id LIMIT 1000) GROUP BY category",
        REVIEWS, RAW),
    "load_complete_rows": with_views(
        """SELECT row_id, category, rating, title, asin, user_id, helpful_vote FROM raw
        WHERE title IS NOT NULL""", REVIEWS, RAW),
    "write_splits": with_views(
        "SELECT split, category AS category_name, count(*) AS n FROM built GROUP BY ALL", REVIEWS, _RAW_ALL, _BUILT),
    "category_slug": """SELECT p_partkey, lower(replace(replace(p_name || ' & ' || p_brand, ' ', '_'), '&', 'and')) AS slug
        FROM part""",
    "category_from_path": """SELECT p_partkey, array_to_string(list_transform(range(1, length(s) + 1), lambda i:
        CASE WHEN i > 1 AND regexp_matches(s[i - 1], '[A-Za-z]') THEN lower(s[i]) ELSE upper(s[i]) END), '') AS category
        FROM (SELECT p_partkey, concat_ws('-', p_name, p_size || 'd', p_type) AS s FROM part)""",
    "combine_sources": """SELECT text, lang, source, url, NULL AS doc_id, min(source_file) AS source_file FROM (
        SELECT text, lang, source, NULL AS url, 'a.parquet' AS source_file FROM documents
        UNION ALL SELECT text, lang, source, NULL, 'b.parquet' FROM documents
        UNION ALL SELECT html, NULL, NULL, url, 'c.parquet' FROM pages) GROUP BY text, lang, source, url
        UNION ALL SELECT DISTINCT text, lang, NULL, NULL, CAST(doc_id AS VARCHAR), 'd.csv' FROM documents
        UNION ALL SELECT DISTINCT text, lang, source, NULL, CAST(doc_id AS VARCHAR), 'e.csv' FROM documents""",
    "clean_text": f"SELECT page_id, {clean_sql('html')} AS cleaned FROM pages",
    "validate_reviews": _VALID_ROWS,
    "has_images": with_views("SELECT row_id, has_images FROM reviews", REVIEWS),
    "compose_review_data": with_views("SELECT row_id, review_data FROM reviews", REVIEWS),
    "filter_token_count": r"""SELECT doc_id, token_count FROM (
        SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) + 2 AS BIGINT) AS token_count
        FROM documents) WHERE token_count <= 512""",
    "reject_counts": with_views(
        "SELECT coalesce(reject_reason, 'valid') AS reject_reason, count(*) AS n FROM checked GROUP BY 1", REVIEWS, RAW, CHECKED),
    "word_count": f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{NON_SPACES}')) AS BIGINT) AS words FROM documents",
    "dedup_full_row": "SELECT min(doc_id) AS row_id, text, lang, source, n_chars FROM documents GROUP BY ALL",
    "dedup_review_rating": with_views(
        f"""SELECT row_id, review_data, {r('rating', 'rating')}, user_id FROM (
        SELECT *, row_number() OVER (PARTITION BY review_data, rating ORDER BY row_id) AS k FROM reviews) WHERE k = 1""", REVIEWS),
    "dedup_counts": with_views(
        """SELECT CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after, CAST(sum(n) - count(*) AS BIGINT) AS removed
        FROM (SELECT count(*) AS n FROM reviews GROUP BY review_data, rating)""", REVIEWS),
    "split_dataset": with_views(
        f"""SELECT row_id, category, {_SPLIT} AS split FROM (
        SELECT row_id, category, row_number() OVER (PARTITION BY category ORDER BY row_id) AS pos FROM reviews)""", REVIEWS),
    "build_dataset": with_views(f"SELECT {_BUILT_COLUMNS} FROM built", REVIEWS, _RAW_ALL, _BUILT),
    "stream_validate": _VALID_ROWS,
    "stream_quota": with_views(
        f"""SELECT {_QUOTA_COLUMNS} FROM (
        SELECT *, row_number() OVER (PARTITION BY category ORDER BY row_id) AS k FROM (
          SELECT min(row_id) AS row_id, * EXCLUDE (row_id) FROM valid GROUP BY ALL)) WHERE k <= {STREAM_QUOTA}""", REVIEWS, RAW, CHECKED),
}
