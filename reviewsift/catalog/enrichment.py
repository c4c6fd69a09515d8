"""Queries on enrichment, features and regression quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewsift import fixtures as fx
from reviewsift.catalog.base import (
    ENRICHED, FEATURES, LOOKUP, REVIEWS, SCALED, enriched, on_enriched, r, remember, rounded, with_views,
)
from reviewsift.operators import enrich, features, rating_model, rating_training, regression
from reviewsift.session import materialize, scratch_path


def _inputs(spark, sf):
    return fx.scored_reviews(spark, sf), fx.product_meta(spark, sf)


def product_ids(spark, sf):
    return enrich.product_ids(fx.scored_reviews(spark, sf))


def product_lookup(spark, sf):
    return rounded(enrich.product_lookup(*_inputs(spark, sf)).select("parent_asin", "average_rating"))


def enrich_reviews(spark, sf):
    reviews, meta = _inputs(spark, sf)
    lookup = enrich.product_lookup(reviews, meta)
    enrich.check_lookup(lookup)
    return rounded(enrich.enrich(reviews, lookup).drop("timestamp"))


def reviews_per_user(spark, sf):
    return enrich.reviews_per_user(fx.scored_reviews(spark, sf))


def enrichment_stats(spark, sf):
    return rounded(enrich.enrichment_stats(enriched(spark, sf)))


def enrichment_coverage(spark, sf):
    reviews, meta = _inputs(spark, sf)
    return rounded(enrich.enrichment_coverage(reviews, enrich.product_lookup(reviews, meta)))


def winsorize_p99(spark, sf):
    return rounded(features.winsorize(enriched(spark, sf)).select(
        "row_id", "helpful_vote", "reviewer_review_count"))


def feature_matrix(spark, sf):
    return rounded(features.feature_matrix(enriched(spark, sf)))


def scaled_features(spark, sf):
    return rounded(features.scaled_features(enriched(spark, sf)))


def outlier_check(spark, sf):
    return rounded(features.outlier_check(enriched(spark, sf)))


def top5_values(spark, sf):
    return rounded(features.top_values(enriched(spark, sf), "helpful_vote"))


def regression_metrics(spark, sf):
    return rounded(regression.regression_metrics(fx.scored_reviews(spark, sf)))


def _model(spark, sf):
    """Trained on the rows outside the validation part, a fifth of the users."""
    def fit():
        rows = fx.reviews(spark, sf)
        return rating_model.train_rating_model(rows.where(~_validation()))
    return remember(spark, sf, "model", fit)


def _validation():
    return F.pmod(F.xxhash64("user_id"), F.lit(5)) == 0


def train_rating_model(spark, sf):
    held_out = fx.reviews(spark, sf).where(_validation())
    return rounded(rating_model.evaluate_rating_model(_model(spark, sf), held_out))


def train_rating_epochs(spark, sf):
    """Validation error of each epoch, trained on the other rows."""
    folder, rows = scratch_path(spark, "epochs"), fx.reviews(spark, sf)
    rating_training.train_epochs(rows.where(~_validation()), rows.where(_validation()), folder, epochs=3)
    return rounded(rating_training.epoch_errors(spark, folder))


def _by_length():
    """A stand-in for a model that SQL can repeat: the rating follows the length of the text."""
    return lambda texts: [1.0 + len(t) % 401 / 100.0 for t in texts]


def score_ratings(spark, sf):
    scored = rating_model.score_with(fx.reviews(spark, sf), _by_length)
    return rounded(scored.select("row_id", "rating", "predicted_rating", "rating_diff"))


def score_unscored(spark, sf):
    """Half-scored input: reviews without helpful votes wait for their score."""
    rows = fx.reviews(spark, sf)
    for c in ("predicted_rating", "rating_diff"):
        rows = rows.withColumn(c, F.when(F.col("helpful_vote") > 0, F.col(c)))
    done = rating_model.score_unscored(rows, lambda d: rating_model.score_with(d, _by_length))
    return rounded(done.select("row_id", "predicted_rating", "rating_diff"))


QUERIES = {
    "product_ids": product_ids, "product_lookup": product_lookup, "enrich_reviews": enrich_reviews,
    "reviews_per_user": reviews_per_user, "enrichment_stats": enrichment_stats,
    "enrichment_coverage": enrichment_coverage, "winsorize_p99": winsorize_p99,
    "feature_matrix": feature_matrix, "scaled_features": scaled_features, "outlier_check": outlier_check,
    "top5_values": top5_values, "regression_metrics": regression_metrics,
    "train_rating_model": train_rating_model, "train_rating_epochs": train_rating_epochs, "score_ratings": score_ratings, "score_unscored": score_unscored,
}

_CLIP = ", ".join(r(f"least({c}, quantile_cont({c}, 0.99) OVER ())", c) for c in ("helpful_vote", "reviewer_review_count"))
_OUTLIERS = " UNION ALL ".join(f"""
    SELECT '{c}' AS feature, {r(f'min({c})', 'min')}, {r(f'max({c})', 'max')},
      {r(f'quantile_cont({c}, 0.95)', 'p95')}, {r(f'quantile_cont({c}, 0.99)', 'p99')},
      {r(f'quantile_cont({c}, 0.999)', 'p999')},
      {r(f'max({c}) / (quantile_cont({c}, 0.95) + CAST(1e-8 AS DOUBLE))', 'max_p95_ratio')},
      max({c}) / (quantile_cont({c}, 0.95) + CAST(1e-8 AS DOUBLE)) > 10 AS extreme
    FROM enriched""" for c in ("helpful_vote", "reviewer_review_count"))
_MATRIX = ", ".join(
    r(f"CAST({c} AS INTEGER)" if c in ("verified_purchase", "has_images") else c, c) for c in FEATURES)

_BY_LENGTH = "CAST(1 AS DOUBLE) + CAST(length(review_data) % 401 AS DOUBLE) / 100"

ORACLES = {
    "product_ids": with_views("SELECT asin AS product_id FROM reviews UNION SELECT parent_asin FROM reviews", REVIEWS),
    "product_lookup": with_views(f"SELECT parent_asin, {r('average_rating', 'average_rating')} FROM lookup", REVIEWS, LOOKUP),
    "enrich_reviews": on_enriched(f"""SELECT row_id, user_id, asin, parent_asin, {r('rating', 'rating')},
        {r('predicted_rating', 'predicted_rating')}, {r('rating_diff', 'rating_diff')}, helpful_vote,
        verified_purchase, has_images, reviewer_review_count,
        {r('rating_vs_product_avg_abs', 'rating_vs_product_avg_abs')} FROM enriched"""),
    "reviews_per_user": with_views(
        "SELECT user_id, count(*) AS reviewer_review_count FROM reviews GROUP BY user_id", REVIEWS),
    "enrichment_stats": on_enriched(f"""SELECT {r('avg(rating_vs_product_avg_abs)', 'mean_abs_deviation')},
        {r('max(rating_vs_product_avg_abs)', 'max_abs_deviation')}, {r('min(rating_vs_product_avg_abs)', 'min_abs_deviation')},
        {r('avg(reviewer_review_count)', 'mean_reviews_per_user')}, min(reviewer_review_count) AS min_reviews_per_user,
        max(reviewer_review_count) AS max_reviews_per_user,
        count(*) FILTER (reviewer_review_count = 1) AS users_with_1_review,
        count(*) FILTER (reviewer_review_count > 10) AS users_with_over_10_reviews,
        count(*) FILTER (rating_vs_product_avg_abs IS NULL) AS missing_deviation FROM enriched"""),
    "enrichment_coverage": with_views(f"""SELECT count(*) AS reviews,
        count(coalesce(a.average_rating, p.average_rating)) AS matched_reviews,
        {r('count(coalesce(a.average_rating, p.average_rating)) * 100.0 / count(*)', 'match_pct')},
        {r('''any_value((SELECT count(*) FROM lookup) * 100.0 / (SELECT count(*) FROM (
            SELECT asin FROM reviews UNION SELECT parent_asin FROM reviews)))''', 'coverage_pct')}
        FROM reviews v LEFT JOIN lookup a ON a.parent_asin = v.asin
        LEFT JOIN lookup p ON p.parent_asin = v.parent_asin""", REVIEWS, LOOKUP),
    "winsorize_p99": on_enriched(f"SELECT row_id, {_CLIP} FROM enriched"),
    "feature_matrix": on_enriched(f"SELECT row_id, {_MATRIX} FROM enriched"),
    "scaled_features": on_enriched(
        "SELECT row_id, " + ", ".join(r(f"z{i}", f"z_{c}") for i, c in enumerate(FEATURES)) + " FROM scaled", SCALED),
    "outlier_check": on_enriched(_OUTLIERS),
    "top5_values": on_enriched(
        f"SELECT {r('helpful_vote', 'value')} FROM (SELECT helpful_vote FROM enriched ORDER BY helpful_vote DESC LIMIT 5)"),
    "regression_metrics": with_views(f"""SELECT count(*) AS n, {r('avg(abs(predicted_rating - rating))', 'mae')},
        {r('sqrt(avg(pow(predicted_rating - rating, 2)))', 'rmse')},
        {r('1 - sum(pow(predicted_rating - rating, 2)) / sum(pow(rating - m, 2))', 'r2')},
        {r('corr(ry, rp)', 'spearman')}
        FROM (SELECT *, avg(rating) OVER () AS m,
          rank() OVER (ORDER BY rating) + (count(*) OVER (PARTITION BY rating) - 1) / 2.0 AS ry,
          rank() OVER (ORDER BY predicted_rating) + (count(*) OVER (PARTITION BY predicted_rating) - 1) / 2.0 AS rp
          FROM reviews)""", REVIEWS),
    "score_ratings": with_views(f"""SELECT row_id, {r('rating', 'rating')}, {r('p', 'predicted_rating')},
        {r('abs(p - rating)', 'rating_diff')} FROM (SELECT *, {_BY_LENGTH} AS p FROM reviews)""", REVIEWS),
    "score_unscored": with_views(f"""SELECT row_id, {r('CASE WHEN helpful_vote > 0 THEN predicted_rating ELSE p END', 'predicted_rating')},
        {r('CASE WHEN helpful_vote > 0 THEN rating_diff ELSE abs(p - rating) END', 'rating_diff')}
        FROM (SELECT *, {_BY_LENGTH} AS p FROM reviews)""", REVIEWS),
}
