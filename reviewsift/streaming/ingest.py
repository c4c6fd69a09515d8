"""Streaming ingest: the batch validation applied to files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from reviewsift.operators.validate import valid_reviews
from reviewsift.schemas import RAW_REVIEW


def stream_reviews(spark: SparkSession, path: str, fmt: str = "json", max_files: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(RAW_REVIEW).format(fmt)
        .option("maxFilesPerTrigger", max_files).load(path)
    )


def start_validated_ingest(spark: SparkSession, source: str, target: str, checkpoint: str,
                           fmt: str = "json", **options) -> StreamingQuery:
    """Append valid rows to a Parquet folder until the present files are consumed.

    Row-wise and stateless, so the result equals ``valid_reviews`` on the same files; a
    restart with the same checkpoint goes on where the last run stopped.
    """
    return (
        valid_reviews(stream_reviews(spark, source, fmt), **options)
        .writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", target).option("compression", "zstd")
        .trigger(availableNow=True)
        .start()
    )
