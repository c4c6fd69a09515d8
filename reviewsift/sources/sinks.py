"""File sinks: samples, splits, anomalies and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsift.functions.text import category_slug
from reviewsift.operators.validate import take_first

SAMPLE_FORMATS = ("json", "csv")
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def csv_writer(df: DataFrame):
    """CSV with a header and doubled quotes; blanks around values are kept."""
    return df.write.options(**CSV)


def save_sample(df: DataFrame, path: str, num_samples: int = 1000, fmt: str = "csv") -> DataFrame:
    """Write the first rows by id as JSON or CSV; returns what was written."""
    if fmt.lower() not in SAMPLE_FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    sample = take_first(df, num_samples)
    if fmt.lower() == "json":
        sample.write.json(path)
    else:
        # nested columns have no CSV form and are written as JSON text
        flat = sample.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c)
                               for c, t in sample.dtypes])
        csv_writer(flat).csv(path)
    return sample


def by_partition(df: DataFrame, keys: Sequence[str]):
    """A writer into folders by ``keys`` with files of bounded size, that can be repeated.

    Rows are gathered by partition and rebalanced, so a small partition is one file and a large one is split at the
    advisory partition size. A repeated or resumed run replaces the partitions it writes and leaves the others.
    """
    writer = df.hint("rebalance", *[F.col(k) for k in keys]).write.mode("overwrite")
    return writer.option("partitionOverwriteMode", "dynamic").partitionBy(*keys)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet", csv_too: bool = False) -> None:
    """All splits under ``split=.../category_name=...`` (see ``by_partition``)."""
    named = df.withColumn("category_name", category_slug("category"))
    keys = ["split", "category_name"]
    by_partition(named, keys).format(fmt).options(**(CSV if fmt == "csv" else {})).save(f"{path}/{fmt}")
    if csv_too and fmt != "csv":
        by_partition(named, keys).options(**CSV).csv(f"{path}/csv")


def write_anomalies(anomalies: DataFrame, path: str, eps: float, min_samples: int,
                    batch_size: int | None) -> None:
    """Anomalies with the run's parameters as columns, in a folder named after them; a repeated run replaces it."""
    (
        anomalies.withColumn("eps", F.lit(eps)).withColumn("min_samples", F.lit(min_samples))
        .withColumn("batch_size", F.lit(batch_size).cast("bigint")).hint("rebalance")
        .write.mode("overwrite").parquet(f"{path}_eps_{eps}_min_samples_{min_samples}_batch_size_{batch_size}")
    )


def write_metrics(report: DataFrame, path: str) -> None:
    """Metric rows as one JSON object per section."""
    (
        report.groupBy("section")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("metrics"))
        .write.json(path)
    )
