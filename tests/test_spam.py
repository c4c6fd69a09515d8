"""Similar reviews within users, against dense vectors in numpy."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewsift.functions.text import STOP_WORDS
from reviewsift.operators import ordering, prefix_groups as P, text_spam as S
from reviewsift.session import materialize

WORDS = "good bad book shoe phone case nice great poor love hate cheap fast slow red blue the a very ok".split()


def posts(seed=0, n=160, users=6):
    rng = random.Random(seed)
    templates = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 14))) for _ in range(12)]
    rows = []
    for i in range(n):
        text = rng.choice(templates)
        if rng.random() < 0.5:
            text += " " + rng.choice(WORDS)
        user = 0 if rng.random() < 0.4 else rng.randrange(users)
        rows.append((i, user, None if rng.random() < 0.05 else text))
    return rows + [(n, 99, "the a"), (n + 1, 99, "the a"), (n + 2, 50, "alone here")]


def reference(rows, threshold, size, max_df=0.9):
    docs = []
    for _, _, text in rows:
        t = [w for w in re.findall(r"\w{2,}", (text or "").lower()) if w not in STOP_WORDS]
        docs.append(Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:])]))
    df, tf = Counter(), Counter()
    for d in docs:
        df.update(d.keys())
        tf.update(d)
    n = len(docs)
    kept = sorted((w for w in tf if df[w] <= max_df * n), key=lambda w: (-tf[w], w))[:size]
    v = np.array([[d[w] * (np.log((1 + n) / (1 + df[w])) + 1) for w in kept] for d in docs])
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    sim = np.round((v / np.where(norm == 0, 1, norm)) @ (v / np.where(norm == 0, 1, norm)).T, 12)
    out = {}
    for user in {r[1] for r in rows}:
        mine = [i for i, r in enumerate(rows) if r[1] == user]
        found = [sim[i, j] for i in mine for j in mine if i != j and sim[i, j] > threshold]
        if len(mine) >= 2 and found:
            out[user] = (len(mine), float(np.mean(found)))
    return out


@pytest.mark.parametrize("seed, threshold, size", [(0, 0.9, 1000), (1, 0.6, 25)])
def test_patterns(spark, seed, threshold, size):
    rows = posts(seed)
    df = spark.createDataFrame(rows, "row_id long, user_id long, text string")
    got = {r.user_id: (r.review_count, r.avg_similarity)
           for r in S.SpamAnalysis(df, threshold=threshold, size=size).patterns().collect()}
    expected = reference(rows, threshold, size)
    assert got.keys() == expected.keys()
    for user, (n, mean) in expected.items():
        assert got[user][0] == n and np.isclose(got[user][1], mean)


def test_patterns_hold_all_reviews_of_their_users(spark, monkeypatch):
    rows = posts(2)
    df = spark.createDataFrame(rows, "row_id long, user_id long, text string").repartition(5, "text")
    analysis = S.SpamAnalysis(df, threshold=0.7)
    expected = {u: sorted(i for i, user, _ in rows if user == u) for u in reference(rows, 0.7, 1000)}
    got = analysis.pattern_reviews().collect()
    assert {r.user_id: r.row_ids for r in got} == expected and all(r.review_count == len(r.row_ids) for r in got)
    monkeypatch.setattr(ordering, "HOT_ROWS", 3)
    assert {r.user_id: r.row_ids for r in analysis.pattern_reviews().collect()} == expected
    plain = sorted((r.user_id, r.review_count, r.avg_similarity) for r in got)
    assert plain == sorted(map(tuple, analysis.patterns().collect()))


def test_hot_user_is_spread(spark, monkeypatch):
    rows = posts(3)
    df = spark.createDataFrame(rows, "row_id long, user_id long, text string")
    plain = sorted(map(tuple, S.SpamAnalysis(df, threshold=0.7).user_pairs().collect()))
    find = ordering.hot_keys
    monkeypatch.setattr(P, "hot_keys", lambda counts, key, weight, floor=0: find(counts, key, weight, 3))
    assert sorted(map(tuple, S.SpamAnalysis(df, threshold=0.7).user_pairs().collect())) == plain and plain


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_refined_keys_find_the_same_pairs(spark, threshold):
    rows = posts(7, 220, 2)
    df = spark.createDataFrame(rows, "row_id long, user_id long, text string")
    found = [sorted(map(tuple, S.SpamAnalysis(df, threshold=threshold, members=m).user_pairs().collect())) for m in (10**6, 2)]
    assert found[0] == found[1] and len(found[0]) > 20


def test_a_users_many_texts_below_the_threshold_make_few_candidates(spark):
    """800 texts with one rare word of the user's own, the rest drawn from words that everybody uses."""
    rng = random.Random(5)
    common = [f"word{i}" for i in range(60)]
    mine = [(i, 1, " ".join(["zyx", *rng.sample(common, 8)])) for i in range(800)]
    others = [(1000 + i, 2 + i % 400, " ".join(rng.sample(common, 9))) for i in range(1600)]
    df = spark.createDataFrame(mine + others, "row_id long, user_id long, text string")
    analysis = S.SpamAnalysis(df, size=200)
    members = materialize(analysis.user_texts.select(F.col("user_id").alias("group_id"), "text_id").where("user_id = 1"), "m")
    terms = materialize(P.ordered_terms(analysis.vectors), "t")
    paired, refined = (P.candidate_pairs(members, terms, 0.9, most).count() for most in (10**6, P.MEMBERS))
    assert refined < 10 * 800 and refined <= paired


def test_graph_sizes(spark):
    users = spark.createDataFrame([(1, 17, 0.97), (2, 3, 0.96), (3, 8, 1.0)],
                                  "user_id long, review_count long, avg_similarity double")
    assert tuple(S.spam_graph_size(users).first()) == (28, 167)
    assert tuple(S.spam_graph_size(users.where("false")).first()) == (0, 0)
    reviews = spark.range(30).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("user_id"))
    assert S.spam_reviews(reviews, users).count() == 20
    lengths = spark.createDataFrame([(1, 227.94117647058823), (2, 92.66666666666667), (3, 128.75)], "user_id long, avg_words double")
    row = S.spam_length_stats(lengths).first()
    assert np.allclose([row.mean_avg_length, row.median_avg_length, row.std_avg_length],
                       [149.7859477124183, 128.75, 57.19371511388592])


def test_no_text_at_all(spark):
    df = spark.createDataFrame([(0, 1, None), (1, 1, "")], "row_id long, user_id long, text string")
    assert S.SpamAnalysis(df).spam_users().count() == 0


def test_large_users_give_the_same_pairs(spark):
    df = spark.createDataFrame(posts(9, 220, 3), "row_id long, user_id long, text string")
    found = [sorted(map(tuple, S.SpamAnalysis(df, threshold=0.6, whole=w).user_pairs().collect())) for w in (10**6, 20, 0)]
    assert found[0] == found[1] == found[2] and len({p[0] for p in found[0]}) > 1


def test_pairs_never_meet_the_rows_of_their_vectors(spark, monkeypatch):
    """A user's 300 texts share most words but are no similar pairs: no stored step has a row per pair."""
    rng = random.Random(2)
    common = [f"word{i}" for i in range(40)]
    df = spark.createDataFrame([(i, i % 2, " ".join(rng.sample(common, 14))) for i in range(600)], "row_id long, user_id long, text string")
    stored = {}
    monkeypatch.setattr(S, "materialize", lambda t, name: stored.setdefault(name, materialize(t, name)))
    S.SpamAnalysis(df).pairs.count()
    assert "candidates" not in stored and max(t.count() for t in stored.values()) <= 600 * 30


def test_frequent_terms_are_exact_for_any_number_of_buckets(spark):
    rows = [(i, i % 5, text) for i, _, text in posts(4, 200)]
    texts = S.distinct_texts(spark.createDataFrame(rows, "row_id long, user_id long, text string"))
    terms = materialize(S.doc_terms(texts), "terms")
    full = S.vocabulary(S.term_stats(terms, texts, 0.3), texts, 15).collect()
    for buckets in (1, 7, 1 << 17):
        frequent = S.frequent_stats(terms, texts, 15, 0.3, buckets)
        assert S.vocabulary(frequent, texts, 15).collect() == full


def test_terms_are_counted_without_a_shuffle(spark):
    rows = [(0, 1, "red shoe red shoe blue"), (1, 1, None), (2, 2, ""), (3, 1, "shoe")]
    texts = materialize(spark.createDataFrame(rows, "text_id long, copies long, text string"), "t")
    found = S.doc_terms(texts)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.where("text_id = 0").select("term", "tf").collect())) == [
        ("blue", 1), ("red", 2), ("red shoe", 2), ("shoe", 2), ("shoe blue", 1), ("shoe red", 1)]
    assert found.count() == 7
    twice = S.doc_terms(texts.unionByName(texts).unionByName(texts.selectExpr("cast(null as long) text_id", "copies", "text")))
    assert {tuple(r) for r in twice.where("text_id = 0 and term like 'red%'").select("term", "tf").collect()} == {("red", 4), ("red shoe", 4)}
