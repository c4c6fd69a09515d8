"""Detect and rank anomalous reviews; choose eps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsift.operators.dbscan import dbscan
from reviewsift.operators.features import winsorize
from reviewsift.operators.nearest import k_distances, rank_anomalies


def detect_anomalies(enriched: DataFrame, eps: float = 0.6, min_samples: int = 12,
                     batch_size: int | None = None) -> DataFrame:
    """Noise rows with all source columns, their cluster (-1), distance and ranks.

    ``winsorize`` the input first to detect on clipped features.
    """
    ranked = rank_anomalies(dbscan(enriched, eps, min_samples, batch_size))
    return enriched.join(ranked, "row_id").withColumn("cluster", F.lit(-1))


def cluster_summary(labels: DataFrame) -> DataFrame:
    """Rows, noise rows and clusters over all batches."""
    cluster = F.when(F.col("cluster") >= 0, F.struct("batch_id", "cluster"))
    return labels.agg(
        F.count("*").alias("points"), F.count_if(F.col("cluster") == -1).alias("noise"),
        F.countDistinct(cluster).alias("clusters"))


def eps_curve(enriched: DataFrame, k: int = 16, clip: bool = True) -> DataFrame:
    """k-distances for choosing eps, by default on features clipped at the 99th percentile."""
    return k_distances(winsorize(enriched) if clip else enriched, k)
