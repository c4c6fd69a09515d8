"""The complete evaluation of detected anomalies as (section, key, value) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsift.operators import profile as P
from reviewsift.operators import text_spam as S


def spam_report(anomalies: DataFrame, **options) -> DataFrame:
    """One row: spam users, size of their graph and the lengths of their reviews."""
    users = S.materialize(S.SpamAnalysis(anomalies, **options).spam_users(), "spam_users")
    count = users.agg(F.count("*")).scalar()
    lengths = S.spam_length_stats(S.spam_user_lengths(anomalies, users))
    names = [c for c in lengths.columns if c != "total_patterns"]
    stats = lengths.agg(F.struct(*[F.max(c).alias(c) for c in names])).scalar()
    return S.spam_graph_size(users).select(
        count.alias("count"), "nodes", "edges", *[stats[c].alias(c) for c in names])


def evaluation_report(anomalies: DataFrame, original: DataFrame) -> DataFrame:
    rows, users = P.metric_rows, P.user_anomaly_stats(anomalies)
    return P.union_metrics([
        rows("anomaly_characteristics", P.anomaly_rate(anomalies, original)),
        rows("anomaly_characteristics", P.feature_stats(anomalies), "feature"),
        rows("anomaly_characteristics", P.category_distribution(anomalies), "category"),
        rows("anomaly_characteristics",
             P.rating_distribution(anomalies).withColumn("rating", F.concat(F.lit("rating_"), "rating")), "rating"),
        rows("basic_metrics", P.anomaly_patterns(anomalies)),
        rows("user_analysis", P.user_anomaly_summary(users)),
        rows("coordinated_attacks", spam_report(anomalies)),
        rows("comparison_with_original", P.compare_features(anomalies, original), "feature"),
    ])
