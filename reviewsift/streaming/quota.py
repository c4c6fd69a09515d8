"""Streamed ingest that keeps the first valid reviews of each category, each different row once.

State is a table beside the stream's checkpoint: id, category and digest of every accepted row, one folder per
micro-batch. A batch skips categories that are full before it cleans anything, drops rows it or the state has
already seen, and accepts the next ones by row id up to what is left of the quota. A batch that is run again after a
failure replaces its own folders and looks only at earlier ones, so it accepts the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from reviewsift.operators.dedup import repeated_ids, row_digest
from reviewsift.operators.ordering import small, with_position
from reviewsift.operators.validate import valid_reviews
from reviewsift.session import materialize
from reviewsift.streaming.ingest import stream_reviews

STATE = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("category", T.StringType()),
                      T.StructField("digest", T.StringType()), T.StructField("batch", T.LongType())])


def _accepted(spark: SparkSession, state: str, before: int) -> DataFrame:
    """State of the batches before this one; an empty table where there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(state)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(state).where(F.col("batch") < before)


def take_batch(batch: DataFrame, batch_id: int, target: str, state: str, quota: int, **options) -> None:
    """Write the rows that a micro-batch adds under ``target`` and ``state``, in folders of its number."""
    spark = batch.sparkSession
    seen = _accepted(spark, state, batch_id)
    counts = materialize(seen.groupBy("category").agg(F.count("*").alias("_had")), "quota_counts")
    # a row per category
    full = F.broadcast(counts.where(F.col("_had") >= quota).select("category"))
    valid = valid_reviews(batch.join(full, "category", "left_anti"), **options)
    valid = materialize(valid.withColumn("digest", row_digest(valid, [c for c in valid.columns if c != "row_id"])), "quota_valid")
    marks = valid.select("row_id", "category", "digest")
    repeats = small(repeated_ids(marks.select("row_id", "digest"), ["digest"]))
    fresh = marks.join(repeats, "row_id", "left_anti").join(seen.select("digest"), "digest", "left_anti")
    placed = with_position(fresh, [F.asc("row_id")], within=["category"]).join(F.broadcast(counts), "category", "left")
    taken = materialize(placed.where(F.col("pos") < quota - F.coalesce("_had", F.lit(0))).select("row_id", "category", "digest"), "quota_taken")
    rows = valid.drop("digest").join(small(taken.select("row_id")), "row_id", "left_semi")
    rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
    taken.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")


def start_quota_ingest(spark: SparkSession, source: str, target: str, checkpoint: str, quota: int,
                       fmt: str = "json", max_files: int = 1000, **options) -> StreamingQuery:
    """Keep up to ``quota`` valid, different rows of each category until the present files are consumed.

    Where files arrive in the order of their row ids, the result is that of the batch operators on all files: valid
    rows, full-row repeats out, the first ``quota`` of each category. A restart goes on where the last run stopped.
    """
    state = f"{checkpoint}/accepted"
    return (
        stream_reviews(spark, source, fmt, max_files).writeStream
        .foreachBatch(lambda df, number: take_batch(df, number, target, state, quota, **options))
        .option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    )


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    """The rows that all batches have kept."""
    return spark.read.parquet(target).drop("batch")
