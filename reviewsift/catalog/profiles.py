"""Queries profiling the anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewsift import fixtures as fx
from reviewsift.catalog.base import (
    ENRICHED, FEATURES, NON_SPACES, REVIEWS, anomalies, anomaly_texts, enriched, enriched_texts, melt_sql,
    on_anomalies, on_both, r, rounded, with_views,
)
from reviewsift.operators import dedup, profile as P
from reviewsift.session import materialize

LENGTH_COLUMNS = ["text", "review_data", "title"]


def _alone(function, texts: bool = False):
    source = anomaly_texts if texts else anomalies
    return lambda spark, sf: rounded(function(source(spark, sf)))


def _versus(function, texts: bool = False):
    a, o = (anomaly_texts, enriched_texts) if texts else (anomalies, enriched)
    return lambda spark, sf: rounded(function(a(spark, sf), o(spark, sf)))


def _users(function):
    return lambda spark, sf: rounded(function(materialize(P.user_anomaly_stats(anomalies(spark, sf)), "users")))


def _lengths(spark, sf, source=anomaly_texts):
    return materialize(P.text_lengths(source(spark, sf)), "lengths")


def normal_reviews(spark, sf):
    return dedup.normal_reviews(enriched(spark, sf), anomalies(spark, sf)).select("row_id", "user_id", "asin")


def length_comparison(spark, sf):
    return rounded(P.length_comparison(_lengths(spark, sf), _lengths(spark, sf, enriched_texts)))


QUERIES = {
    "normal_reviews": normal_reviews,
    "value_counts": lambda spark, sf: rounded(P.value_counts(anomalies(spark, sf), "rating")),
    "feature_stats": _alone(P.feature_stats),
    "anomaly_rate": _versus(P.anomaly_rate),
    "category_distribution": _alone(P.category_distribution, texts=True),
    "rating_distribution": _alone(P.rating_distribution),
    "anomaly_patterns": _alone(P.anomaly_patterns),
    "signed_diff_stats": _alone(P.signed_diff_stats),
    "feature_histogram": _alone(P.feature_histogram),
    "histogram_summary": _alone(P.histogram_summary),
    "feature_quartiles": _alone(P.feature_quartiles),
    "compare_features": _versus(P.compare_features),
    "rating_comparison": _versus(P.rating_comparison),
    "rating_diff_by_rating": _versus(P.rating_diff_by_rating),
    "boxplot_stats": _versus(P.boxplot_stats),
    "boolean_comparison": _versus(P.boolean_comparison),
    "category_share_diff": _versus(P.category_share_diff, texts=True),
    "user_anomaly_stats": _alone(P.user_anomaly_stats),
    "user_anomaly_summary": _users(P.user_anomaly_summary),
    "user_anomaly_distributions": _users(P.user_anomaly_distributions),
    "user_histogram": _users(P.user_histogram),
    "user_percentiles": _users(P.user_percentiles),
    "user_review_groups": _users(P.user_review_groups),
    "length_stats": lambda spark, sf: rounded(P.length_stats(_lengths(spark, sf))),
    "length_extremes": lambda spark, sf: rounded(P.length_extremes(_lengths(spark, sf))),
    "length_correlations": lambda spark, sf: rounded(P.length_correlations(_lengths(spark, sf))),
    "length_comparison": length_comparison,
}

_ALL = melt_sql("anomalies", FEATURES)
_LONG = f"long AS ({_ALL})"


def _bins(source: str, columns, count: int = 30) -> str:
    return f"""
long AS ({melt_sql(source, columns)}),
ends AS (
  SELECT feature, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
    CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi
  FROM long GROUP BY feature
),
spine AS (SELECT feature, lo, (hi - lo) / {count} AS width, bin FROM ends, range(1, {count + 1}) g(bin)),
counts AS (
  SELECT l.feature, least(CAST(floor((l.value - e.lo) / ((e.hi - e.lo) / {count})) AS BIGINT) + 1, {count}) AS bin,
    count(*) AS n FROM long l JOIN ends e USING (feature) GROUP BY 1, 2
)"""


_BINS_BODY = f"""SELECT s.feature, s.bin, {r('s.lo + (s.bin - 1) * s.width', 'bin_start')},
    {r('s.lo + s.bin * s.width', 'bin_end')}, coalesce(c.n, 0) AS n
    FROM spine s LEFT JOIN counts c ON c.feature = s.feature AND c.bin = s.bin"""

_USER_VIEW = """
users AS MATERIALIZED (
  SELECT user_id, count(*) AS anomaly_count, arg_min(reviewer_review_count, row_id) AS reviewer_review_count,
    arg_min(reviewer_review_count, row_id) - count(*) AS normal_reviews,
    count(*) / CAST(arg_min(reviewer_review_count, row_id) AS DOUBLE) AS anomaly_rate
  FROM anomalies GROUP BY user_id
)"""


def _on_users(body: str, *more: str) -> str:
    return on_anomalies(body, _USER_VIEW, *more)


_MEASURES = ["anomaly_count", "reviewer_review_count", "anomaly_rate"]


def _length_view(source: str, name: str = "lengths") -> str:
    parts = []
    for c in LENGTH_COLUMNS:
        parts.append(f"SELECT rating, helpful_vote, '{c}_char' AS feature, CAST(length({c}) AS DOUBLE) AS value FROM {source}")
        parts.append(f"SELECT rating, helpful_vote, '{c}_word' AS feature, "
                     f"CAST(len(regexp_extract_all({c}, '{NON_SPACES}')) AS DOUBLE) AS value FROM {source}")
    return f"\n{name} AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


def _q(p: float, col: str = "value") -> str:
    return f"quantile_cont({col}, {p})"


_PATTERNS = f"""SELECT {r('avg(CAST(rating > predicted_rating AS INTEGER)) * 100', 'positive_diff_pct')},
  {r('avg(CAST(rating < predicted_rating AS INTEGER)) * 100', 'negative_diff_pct')},
  {r('avg(rating_diff)', 'mean_rating_diff')}, """ + ", ".join(
    f"count(*) FILTER ({test}) AS {name}_count, {r(f'count(*) FILTER ({test}) * 100.0 / count(*)', f'{name}_pct')}"
    for name, test in {
        "zero_votes": "helpful_vote = 0", "low_votes": "helpful_vote BETWEEN 1 AND 5", "high_votes": "helpful_vote > 5",
        "verified": "verified_purchase", "unverified": "NOT verified_purchase",
        "with_images": "has_images", "without_images": "NOT has_images"}.items()) + " FROM anomalies"

_BOX = ["helpful_vote", "reviewer_review_count", "rating_diff"]

ORACLES = {
    "normal_reviews": on_both("SELECT row_id, user_id, asin FROM normal"),
    "value_counts": on_anomalies(f"SELECT {r('rating', 'value')}, count(*) AS n FROM anomalies GROUP BY rating"),
    "feature_stats": on_anomalies(f"""SELECT feature, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')},
        {r('min(value)', 'min')}, {r('max(value)', 'max')} FROM long GROUP BY feature""", _LONG),
    "anomaly_rate": on_anomalies(f"""SELECT count(*) AS total_anomalies,
        {r('count(*) / CAST((SELECT count(*) FROM enriched) AS DOUBLE)', 'anomaly_rate')} FROM anomalies"""),
    "category_distribution": on_anomalies(f"""SELECT category, count(*) AS n,
        {r('count(*) * 100.0 / (SELECT count(*) FROM anomalies)', 'pct')} FROM anomalies GROUP BY category"""),
    "rating_distribution": on_anomalies(f"""SELECT CAST(rating AS BIGINT) AS rating, count(*) AS n,
        {r('count(*) * 100.0 / (SELECT count(*) FROM anomalies)', 'pct')} FROM anomalies GROUP BY 1"""),
    "anomaly_patterns": on_anomalies(_PATTERNS),
    "signed_diff_stats": on_anomalies(f"""SELECT {r('avg(rating - predicted_rating)', 'mean_diff')},
        {r('stddev_samp(rating - predicted_rating)', 'std_diff')},
        count(*) FILTER (rating > predicted_rating) AS positive_count,
        count(*) FILTER (rating < predicted_rating) AS negative_count FROM anomalies"""),
    "feature_histogram": on_anomalies(_BINS_BODY, _bins("anomalies", P.HISTOGRAM_FEATURES)),
    "histogram_summary": on_anomalies(f"""SELECT feature, {r('avg(value)', 'mean')}, count(*) AS n,
        {r('median(value)', 'median')} FROM ({melt_sql('anomalies', P.HISTOGRAM_FEATURES)}) GROUP BY feature"""),
    "feature_quartiles": on_anomalies(f"""SELECT feature, {r(_q(.5), 'median')}, {r(_q(.25), 'q25')}, {r(_q(.75), 'q75')},
        {r('max(value) - min(value)', 'range')} FROM ({melt_sql('anomalies', P.NUMERIC)}) GROUP BY feature
        UNION ALL SELECT f, NULL, NULL, NULL, NULL FROM (VALUES ('verified_purchase'), ('has_images')) t(f)"""),
    "compare_features": on_anomalies(f"""SELECT a.feature, {r('a.m - o.m', 'mean_diff')},
        {r('CASE WHEN o.s > 0 THEN a.s / o.s ELSE 0 END', 'std_ratio')}
        FROM (SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM long GROUP BY feature) a
        JOIN (SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM ({melt_sql('enriched', FEATURES)})
          GROUP BY feature) o ON o.feature = a.feature""", _LONG),
    "rating_comparison": on_both(f"""SELECT g.rating,
        {r("coalesce(count(*) FILTER (t.grp = 'anomaly') * 100.0 / (SELECT count(*) FROM anomalies), 0)", 'anomaly_pct')},
        {r("coalesce(count(*) FILTER (t.grp = 'normal') * 100.0 / (SELECT count(*) FROM normal), 0)", 'normal_pct')}
        FROM range(1, 6) g(rating) LEFT JOIN tagged t ON t.rating = g.rating GROUP BY g.rating"""),
    "rating_diff_by_rating": on_both(f"""SELECT grp, {r('rating', 'rating')}, {r('avg(rating_diff)', 'mean')},
        {r('stddev_samp(rating_diff)', 'std')}, count(*) AS n FROM tagged GROUP BY grp, rating"""),
    "boxplot_stats": on_both(f"""SELECT l.grp, l.feature, {r('any_value(q1)', 'q1')}, {r('any_value(md)', 'median')},
        {r('any_value(q3)', 'q3')},
        {r('min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 'whisker_low')},
        {r('max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 'whisker_high')},
        count(*) FILTER (value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers,
        {r('avg(value)', 'mean')}
        FROM boxed l JOIN (SELECT grp, feature, {_q(.25)} AS q1, {_q(.5)} AS md, {_q(.75)} AS q3
          FROM boxed GROUP BY grp, feature) q ON q.grp = l.grp AND q.feature = l.feature
        GROUP BY l.grp, l.feature""", f"boxed AS ({melt_sql('tagged', _BOX, 'grp, ')})"),
    "boolean_comparison": on_both(f"""SELECT grp, feature, {r('avg(value) * 100', 'true_pct')},
        {r('(1 - avg(value)) * 100', 'false_pct')}
        FROM ({melt_sql('tagged', ['verified_purchase', 'has_images'], 'grp, ')}) GROUP BY grp, feature"""),
    "category_share_diff": on_anomalies(f"""SELECT coalesce(a.category, o.category) AS category,
        {r('coalesce(a.pct, 0) - coalesce(o.pct, 0)', 'share_diff')}
        FROM (SELECT category, count(*) * 100.0 / (SELECT count(*) FROM anomalies) AS pct FROM anomalies GROUP BY 1) a
        FULL JOIN (SELECT category, count(*) * 100.0 / (SELECT count(*) FROM enriched) AS pct FROM enriched GROUP BY 1) o
        ON o.category = a.category"""),
    "user_anomaly_stats": _on_users(f"""SELECT user_id, anomaly_count, reviewer_review_count, normal_reviews,
        {r('anomaly_rate', 'anomaly_rate')} FROM users"""),
    "user_anomaly_summary": _on_users(f"""SELECT count(*) AS users, CAST(sum(anomaly_count) AS BIGINT) AS reviews,
        {r('avg(anomaly_count)', 'avg_anomalies')}, max(anomaly_count) AS max_anomalies,
        {r('avg(reviewer_review_count)', 'avg_total_reviews')}, {r('avg(normal_reviews)', 'avg_normal_reviews')},
        count(*) FILTER (anomaly_rate = 1) AS all_anomalous_users,
        count(*) FILTER (anomaly_rate > 0.5) AS high_rate_users FROM users"""),
    "user_anomaly_distributions": _on_users(f"""SELECT feature, {r('avg(value)', 'mean')}, {r('median(value)', 'median')},
        {r('max(value)', 'max')} FROM ({melt_sql('users', _MEASURES)}) GROUP BY feature"""),
    "user_histogram": _on_users(_BINS_BODY, _bins("users", _MEASURES)),
    "user_percentiles": _on_users("SELECT feature, " + ", ".join(r(_q(p / 100), f"p{p}") for p in (25, 50, 75, 90, 95))
                                  + f" FROM ({melt_sql('users', [*_MEASURES, 'normal_reviews'])}) GROUP BY feature"),
    "user_review_groups": _on_users(f"""SELECT count(*) FILTER (reviewer_review_count = 1) AS single_review_users,
        count(*) FILTER (reviewer_review_count > 1) AS multiple_review_users,
        {r('avg(anomaly_rate)', 'avg_anomaly_rate')} FROM users"""),
    "length_stats": on_anomalies(f"""SELECT feature, {r('avg(value)', 'mean')}, {r(_q(.5), 'median')},
        {r('stddev_samp(value)', 'std')}, {r('min(value)', 'min')}, {r('max(value)', 'max')},
        {r(_q(.25), 'q25')}, {r(_q(.75), 'q75')} FROM lengths GROUP BY feature""", _length_view("anomalies")),
    "length_extremes": on_anomalies("""SELECT l.feature, count(*) FILTER (value = 0) AS empty,
        count(*) FILTER (value = 1 AND ends_with(l.feature, '_word')) AS single_word,
        count(*) FILTER (value < CASE WHEN ends_with(l.feature, '_word') THEN 2 ELSE 10 END) AS extremely_short,
        count(*) FILTER (value > m + 2 * s) AS extremely_long, count(*) FILTER (value > m + 3 * s) AS very_long
        FROM lengths l JOIN (SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM lengths GROUP BY feature) t
        ON t.feature = l.feature GROUP BY l.feature""", _length_view("anomalies")),
    "length_correlations": on_anomalies(f"""SELECT feature, {r('corr(value, rating)', 'rating_corr')},
        {r('corr(value, helpful_vote)', 'helpful_corr')} FROM lengths GROUP BY feature""", _length_view("anomalies")),
    "length_comparison": on_anomalies(f"""SELECT a.feature, {r('(a.m - o.m) * 100 / o.m', 'diff_pct')}
        FROM (SELECT feature, avg(value) AS m FROM lengths GROUP BY feature) a
        JOIN (SELECT feature, avg(value) AS m FROM all_lengths GROUP BY feature) o ON o.feature = a.feature""",
        _length_view("anomalies"), _length_view("enriched", "all_lengths")),
}
