"""Review-shaped tables derived from the test data (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsift.functions.text import compose_review_data
from reviewsift.operators.enrich import enrich, product_lookup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for costly row work on a table that is read by fewer tasks than that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def _seconds(ts: str):
    """Whole seconds since 1970 of a zoneless timestamp."""
    days = F.date_diff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def scored_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored reviews without their texts: one row per event."""
    parts = table(spark, sf_dir, "part").count()
    e = table(spark, sf_dir, "events")
    asin = (F.col("event_id") * 7) % parts
    return e.select(
        F.col("event_id").alias("row_id"),
        "user_id",
        asin.alias("asin"),
        (asin - asin % 4).alias("parent_asin"),
        (1 + (F.col("event_id") * 13 + F.col("user_id")) % 5).cast("double").alias("rating"),
        (F.lit(1.0) + ((F.col("event_id") * 31 + F.col("user_id") * 17) % 401).cast("double") / 100)
        .alias("predicted_rating"),
        F.when(F.col("event_type").isin("click", "purchase"), F.floor("value"))
        .otherwise(0).cast("bigint").alias("helpful_vote"),
        (F.col("event_type") == "purchase").alias("verified_purchase"),
        (F.col("event_type") == "view").alias("has_images"),
        _seconds("ts").alias("timestamp"),
    ).withColumn("rating_diff", F.abs(F.col("rating") - F.col("predicted_rating")))


def with_texts(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Add category, title, text and review_data to rows of the review table."""
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    texts = docs.select(
        F.col("doc_id").alias("_doc"), F.col("lang").alias("category"),
        F.substring("text", 1, 40).alias("title"), "text",
    )
    joined = spread(df, "row_id").withColumn("_doc", F.col("row_id") % n).join(texts, "_doc").drop("_doc")
    return joined.withColumn("review_data", compose_review_data("category", "title", "text"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored reviews with category, title and text."""
    return with_texts(spark, sf_dir, scored_reviews(spark, sf_dir))


def product_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("row_id"),
        key.alias("parent_asin"),
        F.when(key % 11 == 0, F.lit(0.0)).when(key % 13 == 0, F.lit(None).cast("double"))
        .otherwise(F.lit(1.0) + (F.col("p_size") % 41).cast("double") / 10).alias("average_rating"),
    )


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews as they arrive: string ids, markup in the text, and faults to be rejected."""
    base = reviews(spark, sf_dir)
    every = lambda n: F.col("row_id") % n == 0
    text = F.col("text")
    return base.select(
        "row_id",
        "category",
        F.when(every(19), F.when(every(2), "0").otherwise("6"))
        .when(every(37), F.lit("five")).otherwise(F.col("rating").cast("string")).alias("rating"),
        F.when(every(17), F.lit(None).cast("string")).otherwise(F.col("title")).alias("title"),
        F.when(every(31), F.lit("<br/>")).otherwise(F.concat(F.lit("<p>"), text, F.lit("</p>"))).alias("text"),
        F.when(F.col("has_images"), F.array(F.struct(F.lit("img").alias("small_image_url"))))
        .alias("images"),
        F.when(every(23), F.lit("  ")).otherwise(F.col("asin").cast("string")).alias("asin"),
        F.col("parent_asin").cast("string").alias("parent_asin"),
        F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("user_id"),
        F.when(every(41), F.lit(0)).otherwise(F.col("timestamp")).cast("bigint").alias("timestamp"),
        "verified_purchase",
        F.when(every(29), F.lit("-2")).otherwise(F.col("helpful_vote").cast("string")).alias("helpful_vote"),
    )


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with product deviation and reviewer activity, without texts."""
    base = scored_reviews(spark, sf_dir)
    return enrich(base, product_lookup(base, product_meta(spark, sf_dir)))
