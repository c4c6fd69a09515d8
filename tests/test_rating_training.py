"""Training in epochs: it learns, keeps the best epoch, and resumes to the same weights."""

import random

import numpy as np
from pyspark.sql import functions as F

from reviewsift.operators import rating_training as R


def reviews(spark, n=600):
    rng = random.Random(3)
    mood = {"great": 5.0, "fine": 4.0, "plain": 3.0, "poor": 2.0, "awful": 1.0}
    filler = [f"thing{i}" for i in range(80)]
    rows = []
    for i in range(n):
        word = rng.choice(list(mood))
        rows.append((i, i % 50, " ".join([word, *rng.choices(filler, k=6)]), mood[word]))
    return spark.createDataFrame(rows + [(n, 1, None, 3.0), (n + 1, 2, "great thing1", None)],
                                 "row_id long, user_id long, review_data string, rating double").repartition(3, "row_id")


def test_learns_on_users_it_has_not_seen_and_resumes(spark, tmp_path):
    df = reviews(spark)
    train, val = df.where("user_id < 40"), df.where("user_id >= 40")
    whole = R.train_epochs(train, val, str(tmp_path / "a"), epochs=4, rate=0.5, buckets=512)
    R.train_epochs(train, val, str(tmp_path / "b"), epochs=2, rate=0.5, buckets=512)
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "b" / "epoch=1").glob("part-*")}
    again = R.train_epochs(train, val, str(tmp_path / "b"), epochs=4, rate=0.5, buckets=512)
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "b" / "epoch=1").glob("part-*")} == before
    assert np.allclose(whole.weights, again.weights, atol=1e-9) and whole.epoch == again.epoch
    errors = {r.epoch: r.rmse for r in R.epoch_errors(spark, str(tmp_path / "a")).collect()}
    assert sorted(errors) == [1, 2, 3, 4] and errors[whole.epoch] == min(errors.values())
    scored = R.with_predictions(val, whole)
    rmse = scored.agg(F.sqrt(F.avg(F.pow(F.col("rating_diff"), 2)))).first()[0]
    constant = val.agg(F.stddev_pop("rating")).first()[0]
    assert abs(rmse - errors[whole.epoch]) < 1e-6 and rmse < 0.7 * constant


def test_steps_equal_plain_ones_on_dense_vectors(spark, tmp_path):
    """One task's epoch, row by row in numpy; terms that come twice count twice."""
    buckets, rng = 32, np.random.default_rng(1)
    rows = [(float(rng.integers(1, 6)), sorted(map(int, rng.integers(0, buckets, rng.integers(0, 12))))) for _ in range(50)]
    df = spark.createDataFrame(rows, "label double, terms array<int>").coalesce(1)
    idf = 1 + rng.random(buckets)
    tf = np.array([np.bincount(t, minlength=buckets) for _, t in rows])
    assert R._document_counts(df, buckets).tolist() == (tf > 0).sum(0).tolist()
    x, y = tf * idf, np.array([r[0] for r in rows])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    w, b, past = np.zeros(buckets), 3.0, np.zeros(buckets)
    for low in range(0, 50, R.STEP_ROWS):
        part = slice(low, low + R.STEP_ROWS)
        off = b + x[part] @ w - y[part]
        slope = x[part].T @ off / len(off)
        past += slope * slope
        w, b = w * (1 - 0.2 * 0.01) - 0.2 * slope / np.sqrt(past + 1e-12), b - 0.2 * off.mean()
    weights, intercept = R._epoch(df, R.RatingWeights(np.zeros(buckets), idf, 3.0, 0), 0.2, 0.01)
    assert np.allclose(weights, w, atol=1e-12) and np.isclose(intercept, b)
    model = R.RatingWeights(w, idf, b, 1)
    assert np.allclose(model.predict([np.array(t[::-1]) for _, t in rows]), b + x @ w)


def test_a_batch_of_rows_is_unpacked_once(spark, monkeypatch):
    calls, sparse = [], R._sparse
    monkeypatch.setattr(R, "_sparse", lambda *a: calls.append(1) or sparse(*a))
    rows = spark.createDataFrame([(1.0, [i % 7, i % 5]) for i in range(200)], "label double, terms array<int>")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, f, _: [*f(df.toArrow().combine_chunks().to_batches())] and df.selectExpr("0L i", "0D v").limit(0))
    R._epoch(rows, R.RatingWeights(np.zeros(8), np.ones(8), 0.0, 0), 0.2, 0.0)
    assert len(calls) == 1


def test_nothing_to_train_on(spark, tmp_path):
    df = reviews(spark, 20)
    constant = R.train_epochs(df, df.where("false"), str(tmp_path / "c"), epochs=0, buckets=64)
    assert constant.epoch == 0 and not constant.weights.any()
    scored = R.with_predictions(df.where("review_data is null"), constant).first()
    assert scored.predicted_rating == constant.intercept
    none = R.train_epochs(df.where("false"), df.where("false"), str(tmp_path / "n"), epochs=1, buckets=64)
    assert none.intercept == 0.0
