"""Feature assembly, scaling, winsorizing and outlier checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsift.operators.quantiles import exact_quantiles, melt
from reviewsift.schemas import FEATURES, require_columns

Z_COLUMNS = [f"z_{c}" for c in FEATURES]


def feature_matrix(df: DataFrame, complete: bool = False) -> DataFrame:
    """``row_id`` and the six features as DOUBLE (flags as 0/1); ``complete`` leaves out rows with a null feature."""
    require_columns(df, ["row_id", *FEATURES], "feature_matrix")
    return (df.na.drop(subset=FEATURES) if complete else df).select("row_id", *[
        (F.col(c).cast("int") if c in ("verified_purchase", "has_images") else F.col(c))
        .cast("double").alias(c) for c in FEATURES
    ])


@dataclass(frozen=True)
class Scale:
    """Mean, divisor and scaled range of each feature (twenty-four numbers)."""

    mean: dict[str, float]
    divisor: dict[str, float]
    low: dict[str, float]
    high: dict[str, float]
    rows: int

    def flag_gap(self, feature: str) -> float:
        """Scaled distance between the two values of a 0/1 feature."""
        return 1.0 / self.divisor[feature]


def fit_scale(features: DataFrame) -> Scale:
    """Mean and population deviation over the whole input; a constant feature divides by 1."""
    row = features.agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"avg_{c}") for c in FEATURES],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in FEATURES],
        *[F.min(c).alias(f"min_{c}") for c in FEATURES],
        *[F.max(c).alias(f"max_{c}") for c in FEATURES],
    ).first()
    mean = {c: row[f"avg_{c}"] or 0.0 for c in FEATURES}
    divisor = {
        c: (row[f"std_{c}"] if row["n"] and row[f"min_{c}"] != row[f"max_{c}"] else 1.0)
        for c in FEATURES
    }
    edge = lambda side, c: ((row[f"{side}_{c}"] or 0.0) - mean[c]) / divisor[c]
    return Scale(mean, divisor, {c: edge("min", c) for c in FEATURES},
                 {c: edge("max", c) for c in FEATURES}, row["n"])


def apply_scale(features: DataFrame, scale: Scale) -> DataFrame:
    """Add ``z_*`` columns."""
    return features.select("*", *[
        ((F.col(c) - F.lit(scale.mean[c])) / F.lit(scale.divisor[c])).alias(f"z_{c}")
        for c in FEATURES
    ])


def scaled_features(df: DataFrame) -> DataFrame:
    features = feature_matrix(df)
    return apply_scale(features, fit_scale(features)).select("row_id", *Z_COLUMNS)


def winsorize(df: DataFrame, columns: tuple[str, ...] = ("helpful_vote", "reviewer_review_count"),
              q: float = 0.99) -> DataFrame:
    """Clip the upper tail of each column at its own exact ``q`` quantile (linear)."""
    limits = exact_quantiles(melt(df, columns), [q]).agg(F.struct(*[
        F.max(F.when(F.col("feature") == c, F.col("q")[0])).alias(c) for c in columns
    ])).scalar()
    return df.withColumns({c: F.least(F.col(c).cast("double"), limits[c]) for c in columns})


def outlier_check(df: DataFrame, columns: tuple[str, ...] = ("helpful_vote", "reviewer_review_count"),
                  max_ratio: float = 10.0) -> DataFrame:
    """Tail quantiles per column and a flag where max exceeds ``max_ratio`` times the 95th."""
    long = melt(df, columns)
    ends = long.groupBy("feature").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    return (
        ends.join(exact_quantiles(long, [0.95, 0.99, 0.999]), "feature")
        .select("feature", "min", "max", F.col("q")[0].alias("p95"), F.col("q")[1].alias("p99"),
                F.col("q")[2].alias("p999"),
                (F.col("max") / (F.col("q")[0] + F.lit(1e-8))).alias("max_p95_ratio"))
        .withColumn("extreme", F.col("max_p95_ratio") > max_ratio)
    )


def top_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The ``n`` largest values, ranked; ties broken by ``row_id``."""
    top = df.select(F.col(column).cast("double").alias("value"), "row_id").orderBy(
        F.desc("value"), "row_id").limit(n)
    return top.select("value")
