"""Shared inputs of the queries, and the SQL views their checks are written against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsift import fixtures as fx
from reviewsift.operators.text_spam import SpamAnalysis
from reviewsift.plans.detection import detect_anomalies
from reviewsift.session import materialize

Query = Callable[[SparkSession, str], DataFrame]

EPS, MIN_SAMPLES, BATCH = 0.6, 12, 4000
DIGITS = 6

_stored: dict[tuple, object] = {}


def remember(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    """One copy of an input per Spark application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = make()
    return _stored[key]


def forget() -> None:
    """Drop remembered inputs, so the next query computes its own (for timing)."""
    _stored.clear()


def enriched(spark, sf) -> DataFrame:
    return remember(spark, sf, "enriched", lambda: materialize(fx.enriched(spark, sf), "enriched"))


def enriched_texts(spark, sf) -> DataFrame:
    return fx.with_texts(spark, sf, enriched(spark, sf))


def anomalies(spark, sf) -> DataFrame:
    return remember(spark, sf, "anomalies", lambda: materialize(
        detect_anomalies(enriched(spark, sf), EPS, MIN_SAMPLES), "anomalies"))


def anomaly_texts(spark, sf) -> DataFrame:
    return fx.with_texts(spark, sf, anomalies(spark, sf))


def spam(spark, sf) -> SpamAnalysis:
    """Spam analysis of all reviews."""
    return remember(spark, sf, "spam", lambda: SpamAnalysis(fx.reviews(spark, sf)))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, whole numbers to BIGINT, as the SQL returns them."""
    out = []
    for name, kind in df.dtypes:
        col = F.col(name)
        if kind == "double":
            col = F.round(col, DIGITS)
        elif kind in ("int", "smallint", "tinyint"):
            col = col.cast("bigint")
        out.append(col.alias(name))
    return df.select(*out)


def r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), {DIGITS}) AS {name}"


def words(items) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in items) + "]"


# --- SQL views ---------------------------------------------------------------------------

FEATURES = ["helpful_vote", "verified_purchase", "has_images", "rating_diff",
            "reviewer_review_count", "rating_vs_product_avg_abs"]

REVIEWS = """
reviews AS (
  SELECT e.event_id AS row_id, e.user_id,
    (e.event_id * 7) % (SELECT count(*) FROM part) AS asin,
    (e.event_id * 7) % (SELECT count(*) FROM part)
      - ((e.event_id * 7) % (SELECT count(*) FROM part)) % 4 AS parent_asin,
    CAST(1 + (e.event_id * 13 + e.user_id) % 5 AS DOUBLE) AS rating,
    CAST(1 AS DOUBLE) + CAST((e.event_id * 31 + e.user_id * 17) % 401 AS DOUBLE) / 100 AS predicted_rating,
    abs(CAST(1 + (e.event_id * 13 + e.user_id) % 5 AS DOUBLE)
      - (CAST(1 AS DOUBLE) + CAST((e.event_id * 31 + e.user_id * 17) % 401 AS DOUBLE) / 100)) AS rating_diff,
    CAST(CASE WHEN e.event_type IN ('click', 'purchase') THEN floor(e.value) ELSE 0 END AS BIGINT) AS helpful_vote,
    e.event_type = 'purchase' AS verified_purchase,
    e.event_type = 'view' AS has_images,
    CAST(date_diff('second', TIMESTAMP '1970-01-01 00:00:00', date_trunc('second', e.ts)) AS BIGINT) AS "timestamp",
    d.lang AS category, substr(d.text, 1, 40) AS title, d.text,
    '[CAT=' || d.lang || '] [TITLE=' || substr(d.text, 1, 40) || '] ' || d.text AS review_data
  FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)
),
product_meta AS (
  SELECT p_partkey AS row_id, p_partkey AS parent_asin,
    CASE WHEN p_partkey % 11 = 0 THEN CAST(0 AS DOUBLE) WHEN p_partkey % 13 = 0 THEN NULL
      ELSE CAST(1 AS DOUBLE) + CAST(p_size % 41 AS DOUBLE) / 10 END AS average_rating
  FROM part
)"""

RAW = """
raw AS (
  SELECT row_id, category,
    CASE WHEN row_id % 19 = 0 THEN CASE WHEN row_id % 2 = 0 THEN '0' ELSE '6' END
      WHEN row_id % 37 = 0 THEN 'five' ELSE CAST(rating AS VARCHAR) END AS rating,
    CASE WHEN row_id % 17 = 0 THEN NULL ELSE title END AS title,
    CASE WHEN row_id % 31 = 0 THEN '<br/>' ELSE '<p>' || text || '</p>' END AS text,
    has_images AS pictured,
    CASE WHEN row_id % 23 = 0 THEN '  ' ELSE CAST(asin AS VARCHAR) END AS asin,
    CAST(parent_asin AS VARCHAR) AS parent_asin,
    ' ' || CAST(user_id AS VARCHAR) AS user_id,
    CASE WHEN row_id % 41 = 0 THEN 0 ELSE "timestamp" END AS "timestamp",
    verified_purchase,
    CASE WHEN row_id % 29 = 0 THEN '-2' ELSE CAST(helpful_vote AS VARCHAR) END AS helpful_vote
  FROM reviews
)"""

SPACES = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NON_SPACES = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]+"


def clean_sql(col: str) -> str:
    return (f"CASE WHEN {col} = ' ' THEN '' ELSE regexp_replace(regexp_replace(regexp_replace("
            f"coalesce({col}, ''), '<[^>]+>', '', 'g'), '{SPACES}+', ' ', 'g'), '\\p{{C}}', '', 'g') END")


def strip_sql(col: str) -> str:
    return f"regexp_replace({col}, '^{SPACES}+|{SPACES}+$', '', 'g')"


PIECES = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"

CHECKED = f"""
typed AS (
  SELECT row_id, category, (title IS NULL OR text IS NULL OR rating IS NULL OR asin IS NULL
      OR parent_asin IS NULL OR user_id IS NULL OR "timestamp" IS NULL
      OR verified_purchase IS NULL OR helpful_vote IS NULL) AS missing,
    {clean_sql('title')} AS title, {clean_sql('text')} AS text,
    TRY_CAST(rating AS DOUBLE) AS rating, CAST(trunc(TRY_CAST(helpful_vote AS DOUBLE)) AS BIGINT) AS helpful_vote,
    {strip_sql('asin')} AS asin, {strip_sql('parent_asin')} AS parent_asin, {strip_sql('user_id')} AS user_id,
    "timestamp", verified_purchase, pictured AS has_images
  FROM raw
),
composed AS (
  SELECT *, '[CAT=' || category || '] [TITLE=' || title || '] ' || text AS review_data FROM typed
),
counted AS (
  SELECT *, len(regexp_extract_all(review_data, '{PIECES}')) + 2 AS token_count FROM composed
),
checked AS (
  SELECT *, CASE WHEN missing THEN 'missing_field'
    WHEN title = '' OR text = '' THEN 'empty_text'
    WHEN rating IS NULL OR NOT (rating BETWEEN 1 AND 5) THEN 'bad_rating'
    WHEN helpful_vote IS NULL OR helpful_vote < 0 THEN 'bad_helpful_vote'
    WHEN "timestamp" = 0 THEN 'bad_timestamp'
    WHEN asin = '' OR parent_asin = '' OR user_id = '' THEN 'blank_id'
    WHEN token_count > 512 THEN 'too_long' END AS reject_reason
  FROM counted
),
valid AS MATERIALIZED (
  SELECT row_id, review_data, rating, CAST(token_count AS BIGINT) AS token_count, category, title, text, has_images,
    asin, parent_asin, user_id, "timestamp", verified_purchase, helpful_vote
  FROM checked WHERE reject_reason IS NULL
)"""

LOOKUP = """
lookup AS (
  SELECT parent_asin, arg_max(average_rating, row_id) AS average_rating FROM product_meta
  WHERE average_rating IS NOT NULL AND average_rating <> 0
    AND parent_asin IN (SELECT asin FROM reviews UNION SELECT parent_asin FROM reviews)
  GROUP BY parent_asin
)"""

ENRICHED = f"""{LOOKUP},
enriched AS MATERIALIZED (
  SELECT v.*, u.n AS reviewer_review_count,
    abs(v.rating - coalesce(a.average_rating, p.average_rating)) AS rating_vs_product_avg_abs
  FROM reviews v
  JOIN (SELECT user_id, count(*) AS n FROM reviews GROUP BY user_id) u ON u.user_id = v.user_id
  LEFT JOIN lookup a ON a.parent_asin = v.asin
  LEFT JOIN lookup p ON p.parent_asin = v.parent_asin
  WHERE coalesce(a.average_rating, p.average_rating) IS NOT NULL
)"""


def _scaled(source: str) -> str:
    values = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c not in ("verified_purchase", "has_images")
                       else f"CAST(CAST({c} AS INTEGER) AS DOUBLE) AS {c}" for c in FEATURES)
    stats = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}"
                      for c in FEATURES)
    zs = ", ".join(f"(f.{c} - t.m_{c}) / t.s_{c} AS z{i}" for i, c in enumerate(FEATURES))
    return f"""
features AS (SELECT row_id, {values} FROM {source}),
scaled AS MATERIALIZED (
  SELECT f.*, {zs}, CAST(0 AS BIGINT) AS batch_id, row_number() OVER (ORDER BY f.row_id) - 1 AS pos
  FROM features f, (SELECT {stats} FROM features) t
)"""


def d2(a: str, b: str) -> str:
    return "(" + " + ".join(f"({a}.z{i} - {b}.z{i}) * ({a}.z{i} - {b}.z{i})" for i in range(6)) + ")"


LIMIT = f"CAST({EPS} AS DOUBLE) * CAST({EPS} AS DOUBLE)"


def cluster_views(batch: str = "0") -> str:
    return f"""
pts AS MATERIALIZED (SELECT row_id, z0, z1, z2, z3, z4, z5, CAST({batch} AS BIGINT) AS b FROM scaled),
degree AS MATERIALIZED (
  SELECT p.row_id, count(*) AS n FROM pts p JOIN pts q ON p.b = q.b AND {d2('p', 'q')} <= {LIMIT} GROUP BY p.row_id
),
core AS MATERIALIZED (SELECT p.* FROM pts p JOIN degree d ON d.row_id = p.row_id AND d.n >= {MIN_SAMPLES}),
outer_rows AS MATERIALIZED (SELECT p.* FROM pts p JOIN degree d ON d.row_id = p.row_id AND d.n < {MIN_SAMPLES}),
reached AS MATERIALIZED (
  SELECT DISTINCT o.row_id FROM outer_rows o JOIN core c ON o.b = c.b AND {d2('o', 'c')} <= {LIMIT}
),
noise AS MATERIALIZED (SELECT o.* FROM outer_rows o WHERE o.row_id NOT IN (SELECT row_id FROM reached))"""


SCALED = _scaled("enriched")
CLUSTERS = cluster_views()
ANOMALIES = """
anomalies AS MATERIALIZED (SELECT e.* FROM enriched e JOIN noise n ON n.row_id = e.row_id)"""
NORMAL = """
normal AS (SELECT e.* FROM enriched e WHERE e.row_id NOT IN (SELECT row_id FROM noise))"""
TAGGED = """
tagged AS (SELECT 'anomaly' AS grp, * FROM anomalies UNION ALL SELECT 'normal' AS grp, * FROM normal)"""


def with_views(body: str, *views: str) -> str:
    return "WITH " + ",".join(views) + "\n" + body


def on_enriched(body: str, *more: str) -> str:
    return with_views(body, REVIEWS, ENRICHED, *more)


def on_anomalies(body: str, *more: str) -> str:
    return with_views(body, REVIEWS, ENRICHED, SCALED, CLUSTERS, ANOMALIES, *more)


def on_both(body: str, *more: str) -> str:
    return on_anomalies(body, NORMAL, TAGGED, *more)


def melt_sql(source: str, columns, extra: str = "") -> str:
    parts = []
    for c in columns:
        value = f"CAST(CAST({c} AS INTEGER) AS DOUBLE)" if c in ("verified_purchase", "has_images") else f"CAST({c} AS DOUBLE)"
        parts.append(f"SELECT {extra}'{c}' AS feature, {value} AS value FROM {source}")
    return " UNION ALL ".join(parts)
