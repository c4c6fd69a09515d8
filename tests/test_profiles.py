import numpy as np
from pyspark.sql import functions as F

from reviewsift.operators import profile as P


def anomalies(spark):
    rows = [(0, 1, 5.0, 4.0, 1.0, 0, True, False, 10, 0.5), (1, 1, 1.0, 3.0, 2.0, 3, False, False, 10, 1.5),
            (2, 2, 1.0, 1.0, 0.0, 9, True, True, 1, 0.0)]
    return spark.createDataFrame(rows, "row_id long, user_id long, rating double, predicted_rating double, rating_diff double, "
                                 "helpful_vote long, verified_purchase boolean, has_images boolean, "
                                 "reviewer_review_count long, rating_vs_product_avg_abs double")


def test_patterns_and_missing_columns(spark):
    row = P.anomaly_patterns(anomalies(spark)).first()
    assert (row.zero_votes_count, row.low_votes_count, row.high_votes_count) == (1, 1, 1)
    assert np.isclose(row.positive_diff_pct, 100 / 3) and row.with_images_count == 1
    bare = P.anomaly_patterns(anomalies(spark).drop("predicted_rating")).first()
    assert bare.positive_diff_pct is None and bare.mean_rating_diff == 1.0


def test_users(spark):
    users = P.user_anomaly_stats(anomalies(spark))
    assert {(r.user_id, r.anomaly_count, r.normal_reviews, r.anomaly_rate) for r in users.collect()} == {
        (1, 2, 8, 0.2), (2, 1, 0, 1.0)}
    total = P.user_anomaly_summary(users).first()
    assert total.avg_normal_reviews == total.avg_total_reviews - total.avg_anomalies
    assert P.user_anomaly_summary(users.where("false")).count() == 0


def test_histogram_of_a_constant(spark):
    df = anomalies(spark).withColumn("rating_diff", F.lit(2.0))
    bins = P.feature_histogram(df, 4, ["rating_diff", "helpful_vote"]).collect()
    flat = sorted((r.bin, r.n, r.bin_start) for r in bins if r.feature == "rating_diff")
    assert [b[1] for b in flat] == [0, 0, 3, 0] and flat[0][2] == 1.5
    votes = sorted((r.bin, r.n) for r in bins if r.feature == "helpful_vote")
    assert [n for _, n in votes] == np.histogram([0, 3, 9], 4)[0].tolist()


def test_comparisons_use_ids_and_common_columns(spark):
    a = anomalies(spark)
    original = a.unionByName(a.withColumn("row_id", F.col("row_id") + 10))
    assert P.rating_comparison(a, original).orderBy("rating").first().normal_pct > 60
    assert P.compare_features(a.drop("has_images"), original).count() == 5
    constant = original.withColumn("helpful_vote", F.lit(1))
    got = P.compare_features(a, constant).where("feature = 'helpful_vote'").first()
    assert got.std_ratio == 0.0 and got.mean_diff == 3.0


def test_no_anomalies(spark):
    none = anomalies(spark).where("false")
    assert P.anomaly_rate(none, anomalies(spark)).first().anomaly_rate == 0.0
    assert P.rating_comparison(none, anomalies(spark)).where("anomaly_pct <> 0").isEmpty()
    assert P.feature_stats(none).isEmpty() and P.feature_histogram(none).isEmpty()
