"""Queries on clustering, anomaly ranking and eps selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewsift.catalog.base import (
    ANOMALIES, BATCH, CLUSTERS, EPS, LIMIT, MIN_SAMPLES, SCALED, _scaled, anomalies, cluster_views, d2, enriched,
    on_anomalies, on_enriched, r, remember, rounded,
)
from reviewsift.operators import nearest
from reviewsift.operators.dbscan import dbscan
from reviewsift.plans.detection import cluster_summary, detect_anomalies, eps_curve
from reviewsift.session import scratch_path
from reviewsift.sources import sinks

K = 16


def _clusters(spark, sf):
    return remember(spark, sf, "clusters", lambda: dbscan(enriched(spark, sf), EPS, MIN_SAMPLES))


def _batched(spark, sf):
    return remember(spark, sf, "batched", lambda: dbscan(enriched(spark, sf), EPS, MIN_SAMPLES, BATCH))


def eps_neighbor_counts(spark, sf):
    return rounded(_clusters(spark, sf).neighbour_counts().select("row_id", "neighbours"))


def core_points(spark, sf):
    return _clusters(spark, sf).core_flags()


def dbscan_clusters(spark, sf):
    """Clusters with their size and first core row."""
    labels = _clusters(spark, sf).labels().where("cluster >= 0")
    return rounded(labels.groupBy("cluster").agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == "core").alias("core_rows"),
        F.min(F.when(F.col("kind") == "core", F.col("row_id"))).alias("first_core")))


def dbscan_labels(spark, sf):
    return rounded(_clusters(spark, sf).labels().select("row_id", "kind", "cluster"))


def dbscan_batched(spark, sf):
    return rounded(nearest.rank_anomalies(_batched(spark, sf)))


def summary(spark, sf):
    return cluster_summary(_clusters(spark, sf).labels())


def rank_anomalies(spark, sf):
    return rounded(nearest.rank_anomalies(_clusters(spark, sf)).select("row_id", "min_dist", "rank"))


def detect(spark, sf):
    return rounded(detect_anomalies(enriched(spark, sf), EPS, MIN_SAMPLES).select(
        "row_id", "user_id", "asin", "rating", "helpful_vote", "verified_purchase", "has_images",
        "rating_diff", "reviewer_review_count", "rating_vs_product_avg_abs", "cluster", "min_dist", "rank"))


def _with_gaps(spark, sf):
    """Enriched reviews of which some lack a feature."""
    rows = enriched(spark, sf)
    gap = lambda n, c: F.when(F.col("row_id") % n != 0, F.col(c)).alias(c)
    return rows.withColumns({c: gap(n, c) for n, c in ((23, "rating_diff"), (29, "helpful_vote"), (31, "has_images"))})


def detect_incomplete(spark, sf):
    """Anomalies of a table with missing features, as the sink stores them."""
    path = scratch_path(spark, "anomalies")
    found = detect_anomalies(_with_gaps(spark, sf), EPS, MIN_SAMPLES)
    sinks.write_anomalies(found.select("row_id", "min_dist", "rank"), path, EPS, MIN_SAMPLES, None)
    stored = spark.read.parquet(f"{path}_eps_{EPS}_min_samples_{MIN_SAMPLES}_batch_size_None")
    return rounded(stored.select("row_id", "min_dist", "rank", "eps", "min_samples"))


def k_distance_curve(spark, sf):
    return rounded(nearest.k_distance_curve(nearest.k_distances(enriched(spark, sf), K)).select("pos", "k_distance"))


def k_distance_stats(spark, sf):
    return rounded(nearest.k_distance_stats(eps_curve(enriched(spark, sf), K)))


QUERIES = {
    "eps_neighbor_counts": eps_neighbor_counts, "core_points": core_points, "dbscan_clusters": dbscan_clusters,
    "dbscan_labels": dbscan_labels, "dbscan_batched": dbscan_batched, "cluster_summary": summary,
    "rank_anomalies": rank_anomalies, "detect_anomalies": detect, "detect_incomplete": detect_incomplete, "k_distance_curve": k_distance_curve,
    "k_distance_stats": k_distance_stats,
}

# Components of the core rows by repeated least labels; each row keeps its best label so far.
_LABELS = f"""
links AS MATERIALIZED (
  SELECT a.row_id AS u, b.row_id AS v FROM core a JOIN core b ON a.b = b.b AND a.row_id <> b.row_id
    AND {d2('a', 'b')} <= {LIMIT}
),
comp AS (
  SELECT row_id, row_id AS label FROM core
  UNION
  SELECT l.v AS row_id, min(c.label) AS label
  FROM comp c JOIN links l ON l.u = c.row_id JOIN recurring.comp k ON k.row_id = l.v
  WHERE c.label < k.label GROUP BY l.v
),
named AS MATERIALIZED (SELECT row_id, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM comp),
border AS (
  SELECT o.row_id, min(n.cluster) AS cluster FROM outer_rows o
  JOIN core c ON o.b = c.b AND {d2('o', 'c')} <= {LIMIT} JOIN named n ON n.row_id = c.row_id GROUP BY o.row_id
),
labels AS MATERIALIZED (
  SELECT row_id, 'core' AS kind, CAST(cluster AS BIGINT) AS cluster FROM named
  UNION ALL SELECT row_id, 'border', cluster FROM border
  UNION ALL SELECT row_id, 'noise', -1 FROM noise
)"""
_LABELS = _LABELS.replace("comp AS (", "comp(row_id, label) USING KEY (row_id) AS (", 1)


def _on_labels(body: str) -> str:
    return on_enriched(body, SCALED, CLUSTERS, _LABELS).replace("WITH ", "WITH RECURSIVE ", 1)


_DISTANCES = f"""
distances AS MATERIALIZED (
  SELECT n.row_id, n.b, min(sqrt({d2('n', 'c')})) AS min_dist FROM noise n LEFT JOIN core c ON c.b = n.b GROUP BY n.row_id, n.b
)"""
_FAR = "coalesce(round(min_dist, 9), 0) DESC, row_id"
_KNN = f"""
kd AS MATERIALIZED (
  SELECT p.row_id, sqrt(list_extract(min({d2('p', 'q')}, {K}), {K})) AS k_distance
  FROM scaled p, scaled q GROUP BY p.row_id
)"""
_CLIPPED = """
clipped AS (
  SELECT row_id, least(helpful_vote, quantile_cont(helpful_vote, 0.99) OVER ()) AS helpful_vote,
    verified_purchase, has_images, rating_diff,
    least(reviewer_review_count, quantile_cont(reviewer_review_count, 0.99) OVER ()) AS reviewer_review_count,
    rating_vs_product_avg_abs FROM enriched
)"""
_COMPLETE = """
complete AS (SELECT * FROM enriched WHERE row_id % 23 <> 0 AND row_id % 29 <> 0 AND row_id % 31 <> 0)"""
_QUANTILES = ", ".join(r(f"quantile_cont(k_distance, {p / 100})", f"p{p}") for p in (25, 50, 75, 90, 95, 99))

ORACLES = {
    "eps_neighbor_counts": on_enriched(
        "SELECT row_id, n AS neighbours FROM degree", SCALED, CLUSTERS),
    "core_points": on_enriched(f"SELECT row_id, n >= {MIN_SAMPLES} AS is_core FROM degree", SCALED, CLUSTERS),
    "dbscan_clusters": _on_labels("""SELECT cluster, count(*) AS n, count(*) FILTER (kind = 'core') AS core_rows,
        min(row_id) FILTER (kind = 'core') AS first_core FROM labels WHERE cluster >= 0 GROUP BY cluster"""),
    "dbscan_labels": _on_labels("SELECT row_id, kind, cluster FROM labels"),
    "dbscan_batched": on_enriched(f"""SELECT row_id, b AS batch_id, {r('min_dist', 'min_dist')},
        row_number() OVER (ORDER BY b, {_FAR}) AS rank,
        row_number() OVER (PARTITION BY b ORDER BY {_FAR}) AS batch_rank FROM distances""",
        SCALED, cluster_views(f"pos // {BATCH}"), _DISTANCES),
    "cluster_summary": _on_labels("""SELECT count(*) AS points, count(*) FILTER (cluster = -1) AS noise,
        count(DISTINCT cluster) FILTER (cluster >= 0) AS clusters FROM labels"""),
    "rank_anomalies": on_enriched(f"""SELECT row_id, {r('min_dist', 'min_dist')},
        row_number() OVER (ORDER BY {_FAR}) AS rank FROM distances""", SCALED, CLUSTERS, _DISTANCES),
    "detect_anomalies": on_anomalies(f"""SELECT row_id, user_id, asin, {r('rating', 'rating')}, helpful_vote,
        verified_purchase, has_images, {r('rating_diff', 'rating_diff')}, reviewer_review_count,
        {r('rating_vs_product_avg_abs', 'rating_vs_product_avg_abs')}, CAST(-1 AS BIGINT) AS cluster,
        {r('min_dist', 'min_dist')}, row_number() OVER (ORDER BY {_FAR}) AS rank
        FROM anomalies JOIN distances USING (row_id)""", _DISTANCES),
    "detect_incomplete": on_enriched(f"""SELECT row_id, {r('min_dist', 'min_dist')},
        row_number() OVER (ORDER BY {_FAR}) AS rank, {r(str(EPS), 'eps')}, CAST({MIN_SAMPLES} AS BIGINT) AS min_samples
        FROM distances""", _COMPLETE, _scaled("complete"), CLUSTERS, _DISTANCES),
    "k_distance_curve": on_enriched(f"""SELECT row_number() OVER (ORDER BY k_distance) - 1 AS pos,
        {r('k_distance', 'k_distance')} FROM kd""", SCALED, _KNN),
    "k_distance_stats": on_enriched(f"""SELECT {r('min(k_distance)', 'min')}, {r('max(k_distance)', 'max')}, {_QUANTILES}
        FROM kd""", _CLIPPED, _scaled("clipped"), _KNN),
}
