"""Profiles of anomalies: features, ratings, comparisons with the other reviews, users, lengths.

Quantiles go through ``exact_quantiles``; everything else is one grouped aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsift.functions.text import word_count
from reviewsift.operators.dedup import normal_reviews
from reviewsift.operators.quantiles import exact_quantiles, melt
from reviewsift.schemas import FEATURES, FLAG_FEATURES

NUMERIC = [f for f in FEATURES if f not in FLAG_FEATURES]
HISTOGRAM_FEATURES = ["helpful_vote", "rating_diff", "reviewer_review_count"]
BOXPLOT_FEATURES = ["helpful_vote", "reviewer_review_count", "rating_diff"]
TEXT_COLUMNS = ["text", "review_data", "title"]


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def share(condition: Column) -> Column:
    """Percent of rows where ``condition`` holds; a null condition counts as false."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int")) * 100


def _tagged(original: DataFrame, anomalies: DataFrame, columns: list[str]) -> DataFrame:
    """Anomalies and the normal rest as one table with ``grp``."""
    return normal_reviews(original, anomalies).select(F.lit("normal").alias("grp"), *columns).unionByName(
        anomalies.select(F.lit("anomaly").alias("grp"), *columns))


# --- anomalies alone ---------------------------------------------------------------------


def feature_stats(anomalies: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    present = [c for c in columns if c in anomalies.columns]
    return melt(anomalies, present).groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def anomaly_rate(anomalies: DataFrame, original: DataFrame) -> DataFrame:
    rows = original.agg(F.count("*").alias("n")).scalar()
    return anomalies.agg(F.count("*").alias("total_anomalies")).select(
        "total_anomalies", F.try_divide(F.col("total_anomalies").cast("double"), rows).alias("anomaly_rate"))


def distribution(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Count and percent per value."""
    total = df.agg(F.count("*")).scalar()
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n")).withColumn(
        "pct", percent(F.col("n"), total))


def category_distribution(anomalies: DataFrame) -> DataFrame:
    return distribution(anomalies, F.col("category"), "category")


def rating_distribution(anomalies: DataFrame) -> DataFrame:
    return distribution(anomalies, F.col("rating").cast("int"), "rating")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, most frequent first."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def anomaly_patterns(anomalies: DataFrame) -> DataFrame:
    """Sign of the rating difference, helpful-vote buckets, verified and image shares.

    Figures whose columns are missing are null.
    """
    have = lambda *cols: all(c in anomalies.columns for c in cols)
    null = F.lit(None)
    n = F.count("*")
    votes, exprs = F.col("helpful_vote"), []
    signed = F.col("rating") - F.col("predicted_rating")
    both = have("rating", "predicted_rating")
    exprs += [
        (share(signed > 0) if both else F.first(null.cast("double"))).alias("positive_diff_pct"),
        (share(signed < 0) if both else F.first(null.cast("double"))).alias("negative_diff_pct"),
        (F.avg("rating_diff") if have("rating_diff") else F.first(null.cast("double"))).alias("mean_rating_diff"),
    ]
    buckets = {"zero_votes": votes == 0, "low_votes": (votes > 0) & (votes <= 5), "high_votes": votes > 5}
    flags = {
        "verified": ("verified_purchase", True), "unverified": ("verified_purchase", False),
        "with_images": ("has_images", True), "without_images": ("has_images", False),
    }
    tests = {k: c if have("helpful_vote") else null.cast("boolean") for k, c in buckets.items()}
    tests |= {k: F.col(c) == v if have(c) else null.cast("boolean") for k, (c, v) in flags.items()}
    for name, test in tests.items():
        exprs += [F.count_if(test).alias(f"{name}_count"),
                  percent(F.count_if(test), n).alias(f"{name}_pct")]
    return anomalies.agg(*exprs)


def signed_diff_stats(df: DataFrame) -> DataFrame:
    signed = F.col("rating") - F.col("predicted_rating")
    return df.agg(
        F.avg(signed).alias("mean_diff"), F.stddev_samp(signed).alias("std_diff"),
        F.count_if(signed > 0).alias("positive_count"), F.count_if(signed < 0).alias("negative_count"))


def feature_histogram(anomalies: DataFrame, bins: int = 30,
                      columns: list[str] = HISTOGRAM_FEATURES) -> DataFrame:
    """Equal-width bins per feature (the last one closed); empty bins are kept.

    A constant feature gets a unit-wide range around its value.
    """
    long = melt(anomalies, columns).where(F.col("value").isNotNull())
    ends = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(
        "feature", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    spine = ends.select("feature", "lo", width.alias("width"),
                        F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    # one row per feature and bin leaves each task
    counts = (
        long.join(F.broadcast(ends), "feature")  # one row per feature
        .groupBy("feature", F.least(F.floor((F.col("value") - F.col("lo")) / width) + 1, F.lit(bins))
                 .cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    return spine.join(counts, ["feature", "bin"], "left").select(
        "feature", "bin", (F.col("lo") + (F.col("bin") - 1) * F.col("width")).alias("bin_start"),
        (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"))


def histogram_summary(anomalies: DataFrame, columns: list[str] = HISTOGRAM_FEATURES) -> DataFrame:
    """Mean, median and count shown next to each histogram."""
    long = melt(anomalies, columns)
    means = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return means.join(exact_quantiles(long, [0.5]).select("feature", F.col("q")[0].alias("median")), "feature")


def feature_quartiles(anomalies: DataFrame) -> DataFrame:
    """Median, quartiles and range per numeric feature; null for the flags."""
    q = exact_quantiles(melt(anomalies, NUMERIC), [0.0, 0.25, 0.5, 0.75, 1.0])
    numeric = q.select("feature", F.col("q")[2].alias("median"), F.col("q")[1].alias("q25"),
                       F.col("q")[3].alias("q75"), (F.col("q")[4] - F.col("q")[0]).alias("range"))
    spark = anomalies.sparkSession
    flags = spark.createDataFrame([(f,) for f in FLAG_FEATURES], "feature string").select(
        "feature", *[F.lit(None).cast("double").alias(c) for c in ("median", "q25", "q75", "range")])
    return numeric.unionByName(flags)


# --- anomalies against the rest ----------------------------------------------------------


def compare_features(anomalies: DataFrame, original: DataFrame) -> DataFrame:
    """Mean difference and deviation ratio per feature; the original includes the anomalies."""
    common = [f for f in FEATURES if f in anomalies.columns and f in original.columns]
    stats = lambda df, p: melt(df, common).groupBy("feature").agg(
        F.avg("value").alias(f"{p}_mean"), F.stddev_samp("value").alias(f"{p}_std"))
    return stats(anomalies, "a").join(stats(original, "o"), "feature").select(
        "feature", (F.col("a_mean") - F.col("o_mean")).alias("mean_diff"),
        F.when(F.col("o_std") > 0, F.col("a_std") / F.col("o_std")).otherwise(0.0).alias("std_ratio"))


def rating_comparison(anomalies: DataFrame, original: DataFrame) -> DataFrame:
    """Percent of each rating 1..5 among anomalies and among normal reviews."""
    tagged = _tagged(original, anomalies, ["rating"])
    is_group = lambda g: F.col("grp") == g
    per_rating = tagged.groupBy("rating").agg(
        F.count_if(is_group("anomaly")).alias("a"), F.count_if(is_group("normal")).alias("n"))
    per_rating = per_rating.unionByName(anomalies.sparkSession.createDataFrame(
        [(float(r), 0, 0) for r in range(1, 6)], "rating double, a long, n long"))
    totals = tagged.agg(F.struct(F.count_if(is_group("anomaly")).alias("a"),
                                 F.count_if(is_group("normal")).alias("n"))).scalar()
    return (
        per_rating.groupBy("rating").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
        .where(F.col("rating").isin(1.0, 2.0, 3.0, 4.0, 5.0))
        .select(F.col("rating").cast("int").alias("rating"),
                F.coalesce(percent(F.col("a"), totals["a"]), F.lit(0.0)).alias("anomaly_pct"),
                F.coalesce(percent(F.col("n"), totals["n"]), F.lit(0.0)).alias("normal_pct"))
    )


def rating_diff_by_rating(anomalies: DataFrame, original: DataFrame) -> DataFrame:
    return _tagged(original, anomalies, ["rating", "rating_diff"]).groupBy("grp", "rating").agg(
        F.avg("rating_diff").alias("mean"), F.stddev_samp("rating_diff").alias("std"),
        F.count("rating_diff").alias("n"))


def boxplot_stats(anomalies: DataFrame, original: DataFrame,
                  columns: list[str] = BOXPLOT_FEATURES) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 IQR, outlier count and mean per group."""
    long = melt(_tagged(original, anomalies, columns), columns, by=["grp"]).where(F.col("value").isNotNull())
    q = exact_quantiles(long, [0.25, 0.5, 0.75], by=["grp", "feature"])
    q = q.select("grp", "feature", *[F.col("q")[i].alias(n) for i, n in enumerate(["q1", "median", "q3"])])
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("value").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    # two groups per feature: a handful of rows
    return long.join(F.broadcast(q), ["grp", "feature"]).groupBy("grp", "feature", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"), F.avg("value").alias("mean"))


def boolean_comparison(anomalies: DataFrame, original: DataFrame) -> DataFrame:
    long = melt(_tagged(original, anomalies, FLAG_FEATURES), FLAG_FEATURES, by=["grp"])
    return long.groupBy("grp", "feature").agg(
        (F.avg("value") * 100).alias("true_pct"), ((1 - F.avg("value")) * 100).alias("false_pct"))


def category_share_diff(anomalies: DataFrame, original: DataFrame) -> DataFrame:
    """Category share among anomalies minus share in the original, in percentage points."""
    a = category_distribution(anomalies).select("category", F.col("pct").alias("a"))
    o = category_distribution(original).select("category", F.col("pct").alias("o"))
    return a.join(o, "category", "full").select(
        "category", (F.coalesce("a", F.lit(0.0)) - F.coalesce("o", F.lit(0.0))).alias("share_diff"))


# --- users -------------------------------------------------------------------------------


def user_anomaly_stats(anomalies: DataFrame) -> DataFrame:
    """Per user: anomalies, reviews in total, the normal rest and the rate."""
    return (
        anomalies.where(F.col("user_id").isNotNull()).groupBy("user_id")
        .agg(F.count("*").alias("anomaly_count"),
             F.min_by("reviewer_review_count", F.when(F.col("reviewer_review_count").isNotNull(), F.col("row_id")))
             .alias("reviewer_review_count"))
        .withColumn("normal_reviews", F.col("reviewer_review_count") - F.col("anomaly_count"))
        .withColumn("anomaly_rate", F.try_divide(F.col("anomaly_count").cast("double"), F.col("reviewer_review_count")))
        .na.drop("any")
    )


def user_anomaly_summary(users: DataFrame) -> DataFrame:
    """Totals over ``user_anomaly_stats``; no row where there are no users."""
    return users.agg(
        F.count("*").alias("users"),
        F.sum("anomaly_count").alias("reviews"),
        F.avg("anomaly_count").alias("avg_anomalies"),
        F.max("anomaly_count").alias("max_anomalies"),
        F.avg("reviewer_review_count").alias("avg_total_reviews"),
        F.avg("normal_reviews").alias("avg_normal_reviews"),
        F.count_if(F.col("anomaly_rate") == 1).alias("all_anomalous_users"),
        F.count_if(F.col("anomaly_rate") > 0.5).alias("high_rate_users"),
    ).where(F.col("users") > 0)


USER_MEASURES = ["anomaly_count", "reviewer_review_count", "anomaly_rate"]


def user_anomaly_distributions(users: DataFrame) -> DataFrame:
    """Mean, median and maximum per user measure."""
    long = melt(users, USER_MEASURES)
    ends = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.max("value").alias("max"))
    return ends.join(exact_quantiles(long, [0.5]), "feature").select(
        "feature", "mean", F.col("q")[0].alias("median"), "max")


def user_histogram(users: DataFrame, bins: int = 30) -> DataFrame:
    return feature_histogram(users, bins, USER_MEASURES)


def user_percentiles(users: DataFrame) -> DataFrame:
    """Percentiles per user measure."""
    names = ["p25", "p50", "p75", "p90", "p95"]
    measures = [*USER_MEASURES, "normal_reviews"]
    q = exact_quantiles(melt(users, measures), [0.25, 0.5, 0.75, 0.9, 0.95])
    return q.select("feature", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def user_review_groups(users: DataFrame) -> DataFrame:
    """Users whose only review is anomalous, and users with more reviews; mean rate."""
    total = F.col("reviewer_review_count")
    return users.agg(F.count_if(total == 1).alias("single_review_users"),
                     F.count_if(total > 1).alias("multiple_review_users"),
                     F.avg("anomaly_rate").alias("avg_anomaly_rate"))


# --- text lengths ------------------------------------------------------------------------


def text_lengths(df: DataFrame, columns: list[str] = TEXT_COLUMNS) -> DataFrame:
    """``(row_id, measure, value, rating, helpful_vote)``: characters and words per text column."""
    measures = []
    for c in columns:
        text = F.coalesce(F.col(c), F.lit(""))
        measures += [F.struct(F.lit(f"{c}_char").alias("feature"), F.length(text).cast("double").alias("value")),
                     F.struct(F.lit(f"{c}_word").alias("feature"), word_count(text).cast("double").alias("value"))]
    extra = [c for c in ("rating", "helpful_vote") if c in df.columns]
    return df.select("row_id", *extra, F.explode(F.array(*measures)).alias("m")).select(
        "row_id", *extra, "m.feature", "m.value")


def length_stats(lengths: DataFrame) -> DataFrame:
    ends = lengths.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return ends.join(exact_quantiles(lengths, [0.25, 0.5, 0.75]), "feature").select(
        "feature", "mean", F.col("q")[1].alias("median"), "std", "min", "max",
        F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"))


def length_extremes(lengths: DataFrame, short_chars: int = 10, short_words: int = 2,
                    long_sigmas: float = 2.0, very_long_sigmas: float = 3.0) -> DataFrame:
    """Counts of empty, one-word, very short and very long texts per measure."""
    stats = lengths.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    words = F.endswith("feature", F.lit("_word"))
    short = F.when(words, F.lit(short_words)).otherwise(F.lit(short_chars))
    return lengths.join(F.broadcast(stats), "feature").groupBy("feature").agg(  # one row per measure
        F.count_if(F.col("value") == 0).alias("empty"),
        F.count_if(words & (F.col("value") == 1)).alias("single_word"),
        F.count_if(F.col("value") < short).alias("extremely_short"),
        F.count_if(F.col("value") > F.col("m") + long_sigmas * F.col("s")).alias("extremely_long"),
        F.count_if(F.col("value") > F.col("m") + very_long_sigmas * F.col("s")).alias("very_long"))


def length_correlations(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("feature").agg(
        F.corr("value", "rating").alias("rating_corr"),
        F.corr("value", F.col("helpful_vote").cast("double")).alias("helpful_corr"))


def length_comparison(anomaly_lengths: DataFrame, original_lengths: DataFrame) -> DataFrame:
    """Percent by which the anomalies' mean length differs from the original's."""
    a = anomaly_lengths.groupBy("feature").agg(F.avg("value").alias("a"))
    o = original_lengths.groupBy("feature").agg(F.avg("value").alias("o"))
    return a.join(o, "feature").select("feature", F.try_divide((F.col("a") - F.col("o")) * 100, F.col("o")).alias("diff_pct"))


# --- report ------------------------------------------------------------------------------


def metric_rows(section: str, table: DataFrame, prefix: str | None = None) -> DataFrame:
    """A small result table as ``(section, key, value)`` rows.

    ``prefix`` names the column whose value leads the key; without it the table has one row.
    """
    kinds = dict(table.dtypes)
    cols = [c for c in table.columns if c != prefix]
    key = lambda c: F.concat_ws("_", *([F.col(prefix).cast("string")] if prefix else []), F.lit(c))
    number = lambda c: (F.col(c).cast("int") if kinds[c] == "boolean" else F.col(c)).cast("double")
    return table.select(F.explode(F.array(*[
        F.struct(F.lit(section).alias("section"), key(c).alias("key"), number(c).alias("value")) for c in cols
    ])).alias("m")).select("m.*")


def union_metrics(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
