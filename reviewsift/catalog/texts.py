"""Queries on text similarity, spam users and the full report."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewsift import fixtures as fx
from reviewsift.catalog import profiles
from reviewsift.catalog.base import (
    NON_SPACES, REVIEWS, anomaly_texts, enriched_texts, on_anomalies, r, remember, rounded, spam, with_views, words,
)
from reviewsift.functions.text import STOP_WORDS, tokens
from reviewsift.operators import text_spam as S
from reviewsift.plans.evaluation import evaluation_report, spam_report
from reviewsift.session import materialize


def _documents(spark, sf):
    return fx.spread(fx.table(spark, sf, "documents").withColumnRenamed("doc_id", "row_id"), "row_id")


def tokenize_text(spark, sf):
    found = _documents(spark, sf).select("row_id", tokens("text").alias("t"))
    return rounded(found.select("row_id", F.size("t").alias("tokens"), F.array_join("t", " ").alias("joined")))


def ngram_terms(spark, sf):
    return S.doc_terms(_documents(spark, sf), ids=["row_id"])


def _document_vectors(spark, sf):
    def make():
        docs = _documents(spark, sf).withColumn("user_id", F.col("source"))
        return S.SpamAnalysis(docs)
    return remember(spark, sf, "document_vectors", make)


def term_stats(spark, sf):
    return rounded(_document_vectors(spark, sf).stats)


def tfidf_vocabulary(spark, sf):
    return rounded(_document_vectors(spark, sf).vocabulary)


def tfidf_weights(spark, sf):
    """One vector per different text, with the number of its copies."""
    return rounded(_document_vectors(spark, sf).vectors.select("text_id", "copies", "term", "weight"))


def user_pair_similarity(spark, sf):
    return rounded(spam(spark, sf).user_pairs())


def spam_patterns(spark, sf):
    """Users with similar reviews, and the ids of all their reviews, separated by spaces."""
    found = spam(spark, sf).pattern_reviews()
    return rounded(found.withColumn("row_ids", F.array_join(F.col("row_ids").cast("array<string>"), " ")))


def spam_users(spark, sf):
    return rounded(spam(spark, sf).spam_users())


def spam_graph_nodes(spark, sf):
    return S.spam_reviews(fx.scored_reviews(spark, sf).select("row_id", "user_id"), spam(spark, sf).spam_users())


def spam_graph_cliques(spark, sf):
    return rounded(S.spam_graph_cliques(spam(spark, sf).spam_users()))


def spam_graph_size(spark, sf):
    return rounded(S.spam_graph_size(spam(spark, sf).spam_users()))


def spam_length_stats(spark, sf):
    users = materialize(spam(spark, sf).spam_users(), "spam_users")
    return rounded(S.spam_length_stats(S.spam_user_lengths(fx.reviews(spark, sf), users)))


def report_of_spam(spark, sf):
    return rounded(spam_report(anomaly_texts(spark, sf)))


def report(spark, sf):
    anomalies = materialize(anomaly_texts(spark, sf).drop("review_data"), "report_input")
    return rounded(evaluation_report(anomalies, enriched_texts(spark, sf)))


QUERIES = {
    "tokenize_text": tokenize_text, "ngram_terms": ngram_terms, "term_stats": term_stats,
    "tfidf_vocabulary": tfidf_vocabulary, "tfidf_weights": tfidf_weights,
    "user_pair_similarity": user_pair_similarity, "spam_patterns": spam_patterns, "spam_users": spam_users,
    "spam_graph_nodes": spam_graph_nodes, "spam_graph_cliques": spam_graph_cliques,
    "spam_graph_size": spam_graph_size, "spam_length_stats": spam_length_stats,
    "spam_report": report_of_spam, "evaluation_report": report,
}

_TERM = r"[\p{L}\p{N}_]{2,}"
_TOKENS = f"""list_filter(regexp_extract_all(lower(text), '{_TERM}'), lambda t: NOT list_contains({words(STOP_WORDS)}, t))"""


def _vectors(source: str) -> str:
    """Vectors of the different texts of a table with row_id, user_id and text."""
    return f"""
texts AS MATERIALIZED (
  SELECT min(row_id) AS text_id, count(*) AS copies, text FROM (SELECT row_id, coalesce(text, '') AS text FROM {source})
  GROUP BY text
),
token_lists AS MATERIALIZED (SELECT text_id, copies, {_TOKENS} AS t FROM texts),
grams AS (
  SELECT text_id, copies, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term
  FROM token_lists
),
doc_terms AS MATERIALIZED (SELECT text_id, copies, term, count(*) AS tf FROM grams GROUP BY ALL),
total AS (SELECT sum(copies) AS n FROM texts),
stats AS MATERIALIZED (
  SELECT term, CAST(sum(copies) AS BIGINT) AS df, CAST(sum(copies * tf) AS BIGINT) AS tf FROM doc_terms GROUP BY term
  HAVING sum(copies) <= CAST(0.9 AS DOUBLE) * (SELECT n FROM total)
),
vocabulary AS MATERIALIZED (
  SELECT term, df, tf, ln((1 + (SELECT n FROM total)) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM stats
  ORDER BY tf DESC, term LIMIT 1000
),
raw_vectors AS (
  SELECT d.text_id, d.copies, d.term, d.tf * v.idf AS w FROM doc_terms d JOIN vocabulary v ON v.term = d.term
),
vectors AS MATERIALIZED (
  SELECT text_id, copies, term, w / sqrt(sum(w * w) OVER (PARTITION BY text_id)) AS weight FROM raw_vectors
)"""


def _patterns(source: str) -> str:
    return f"""{_vectors(source)},
user_texts AS MATERIALIZED (
  SELECT s.user_id, t.text_id, count(*) AS posts, min(s.row_id) AS row_id
  FROM {source} s JOIN texts t ON t.text = coalesce(s.text, '') GROUP BY s.user_id, t.text_id
),
user_terms AS MATERIALIZED (
  SELECT u.user_id, u.text_id, u.row_id, u.posts, v.term, v.weight
  FROM user_texts u JOIN vectors v ON v.text_id = u.text_id
),
alike AS MATERIALIZED (
  SELECT a.user_id, a.row_id AS row_a, b.row_id AS row_b, a.posts AS posts_a, b.posts AS posts_b,
    round(sum(a.weight * b.weight), 12) AS similarity
  FROM user_terms a JOIN user_terms b ON a.user_id = b.user_id AND a.term = b.term AND a.row_id < b.row_id
  GROUP BY ALL HAVING round(sum(a.weight * b.weight), 12) > 0.9
),
pair_sums AS (
  SELECT user_id, posts_a * posts_b AS pairs, posts_a * posts_b * similarity AS total FROM alike
  UNION ALL
  SELECT user_id, posts * (posts - 1) / 2, posts * (posts - 1) / 2 FROM user_texts
  WHERE posts > 1 AND text_id IN (SELECT text_id FROM vectors)
),
patterns AS MATERIALIZED (
  SELECT c.user_id, c.review_count, s.avg_similarity
  FROM (SELECT user_id, CAST(sum(posts) AS BIGINT) AS review_count FROM user_texts GROUP BY user_id) c
  JOIN (SELECT user_id, sum(total) / sum(pairs) AS avg_similarity FROM pair_sums GROUP BY user_id) s
  ON s.user_id = c.user_id WHERE c.review_count >= 2
),
spam_users AS (SELECT * FROM patterns WHERE review_count >= 3),
user_lengths AS (
  SELECT s.user_id, avg(len(regexp_extract_all(s.text, '{NON_SPACES}'))) AS avg_words
  FROM {source} s JOIN spam_users p ON p.user_id = s.user_id GROUP BY s.user_id
)"""


_DOCS = "docs AS (SELECT doc_id AS row_id, source AS user_id, text FROM documents)"


def _on_documents(body: str) -> str:
    return with_views(body, _DOCS, _vectors("docs"))


def _on_reviews(body: str) -> str:
    return with_views(body, REVIEWS, _patterns("reviews"))


_SPAM_LENGTHS = f"""{r('avg(avg_words)', 'mean_avg_length')}, {r('median(avg_words)', 'median_avg_length')},
    {r('stddev_pop(avg_words)', 'std_avg_length')}"""

_SPAM_REPORT = on_anomalies(f"""SELECT (SELECT count(*) FROM spam_users) AS count,
        (SELECT CAST(coalesce(sum(review_count), 0) AS BIGINT) FROM spam_users) AS nodes,
        (SELECT CAST(coalesce(sum(review_count * (review_count - 1) // 2), 0) AS BIGINT) FROM spam_users) AS edges,
        {_SPAM_LENGTHS} FROM user_lengths""", _patterns("anomalies"))

_PARTS = {  # section, SQL of the part, its columns, the column that leads the key
    "rate": ("anomaly_characteristics", profiles.ORACLES["anomaly_rate"], "total_anomalies anomaly_rate", None),
    "stats": ("anomaly_characteristics", profiles.ORACLES["feature_stats"], "mean std min max", "feature"),
    "categories": ("anomaly_characteristics", profiles.ORACLES["category_distribution"], "n pct", "category"),
    "ratings": ("anomaly_characteristics", profiles.ORACLES["rating_distribution"], "n pct", "'rating_' || rating"),
    "patterns": ("basic_metrics", profiles.ORACLES["anomaly_patterns"],
                 "positive_diff_pct negative_diff_pct mean_rating_diff " + " ".join(
                     f"{n}_count {n}_pct" for n in ("zero_votes", "low_votes", "high_votes", "verified",
                                                    "unverified", "with_images", "without_images")), None),
    "people": ("user_analysis", profiles.ORACLES["user_anomaly_summary"],
               "users reviews avg_anomalies max_anomalies avg_total_reviews avg_normal_reviews "
               "all_anomalous_users high_rate_users", None),
    "spam": ("coordinated_attacks", None,
             "count nodes edges mean_avg_length median_avg_length std_avg_length", None),
    "compared": ("comparison_with_original", profiles.ORACLES["compare_features"], "mean_diff std_ratio", "feature"),
}


def _report_sql() -> str:
    parts, rows = [], []
    for name, (section, sql, columns, lead) in _PARTS.items():
        parts.append(f"part_{name} AS MATERIALIZED ({sql or _SPAM_REPORT})")
        for c in columns.split():
            key = f"{lead} || '_{c}'" if lead else f"'{c}'"
            rows.append(f"SELECT '{section}' AS section, {key} AS key, CAST({c} AS DOUBLE) AS value FROM part_{name}")
    return "WITH " + ",\n".join(parts) + "\n" + " UNION ALL ".join(rows)


ORACLES = {
    "tokenize_text": f"""SELECT row_id, CAST(len(t) AS BIGINT) AS tokens, array_to_string(t, ' ') AS joined
        FROM (SELECT doc_id AS row_id, {_TOKENS} AS t FROM documents)""",
    "ngram_terms": f"""SELECT row_id, term, count(*) AS tf FROM (
        SELECT row_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term
        FROM (SELECT doc_id AS row_id, {_TOKENS} AS t FROM documents)) GROUP BY row_id, term""",
    "term_stats": _on_documents("SELECT term, df, tf FROM stats"),
    "tfidf_vocabulary": _on_documents(f"SELECT term, df, tf, {r('idf', 'idf')} FROM vocabulary"),
    "tfidf_weights": _on_documents(f"SELECT text_id, copies, term, {r('weight', 'weight')} FROM vectors"),
    "user_pair_similarity": _on_reviews(
        f"SELECT user_id, row_a, row_b, posts_a, posts_b, {r('similarity', 'similarity')} FROM alike"),
    "spam_patterns": _on_reviews(f"""SELECT p.user_id, p.review_count, {r('p.avg_similarity', 'avg_similarity')},
        (SELECT string_agg(CAST(v.row_id AS VARCHAR), ' ' ORDER BY v.row_id) FROM reviews v WHERE v.user_id = p.user_id) AS row_ids
        FROM patterns p"""),
    "spam_users": _on_reviews(f"SELECT user_id, review_count, {r('avg_similarity', 'avg_similarity')} FROM spam_users"),
    "spam_graph_nodes": _on_reviews(
        "SELECT v.row_id, v.user_id FROM reviews v JOIN spam_users s ON s.user_id = v.user_id"),
    "spam_graph_cliques": _on_reviews(f"""SELECT user_id, review_count AS nodes,
        review_count * (review_count - 1) // 2 AS edges, {r('avg_similarity', 'weight')} FROM spam_users"""),
    "spam_graph_size": _on_reviews("""SELECT CAST(coalesce(sum(review_count), 0) AS BIGINT) AS nodes,
        CAST(coalesce(sum(review_count * (review_count - 1) // 2), 0) AS BIGINT) AS edges FROM spam_users"""),
    "spam_length_stats": _on_reviews(f"SELECT {_SPAM_LENGTHS}, count(*) AS total_patterns FROM user_lengths"),
    "spam_report": _SPAM_REPORT,
    "evaluation_report": _report_sql(),
}
