"""Exact quantiles (linear interpolation) that never gather a column in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewsift.session import materialize


def melt(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long form ``(by..., feature, value)`` of numeric and boolean columns."""
    kinds = dict(df.dtypes)
    number = lambda c: (F.col(c).cast("int") if kinds[c] == "boolean" else F.col(c)).cast("double")
    return df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), number(c).alias("value")) for c in columns
    ])).alias("_kv")).select(*by, "_kv.feature", "_kv.value")


def exact_quantiles(long: DataFrame, qs: Sequence[float], by: Sequence[str] = ("feature",),
                    value: str = "value") -> DataFrame:
    """One row per ``by`` group: ``n`` and ``q``, the array of exact quantiles of ``value``.

    Equal values collapse first; the distinct values are range-partitioned and get cumulative
    counts slice by slice, so a group of any size is spread over all tasks.
    """
    by = list(by)
    slices = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = (
        long.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    )
    sliced = materialize(
        counts.repartitionByRange(slices, *by, "_v").withColumn("_slice", F.spark_partition_id()),
        "quantiles",
    )
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (  # at most one row per group and slice
        sliced.groupBy(*by, "_slice").agg(F.sum("_n").alias("_sn"))
        .withColumn("_start", F.coalesce(F.sum("_sn").over(before), F.lit(0)))
        .withColumn("n", F.sum("_sn").over(Window.partitionBy(*by)))
    )
    upto = Window.partitionBy(*by, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        sliced.join(starts, [*by, "_slice"])
        .withColumn("_hi", F.col("_start") + F.sum("_n").over(upto))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
    )

    def value_at(index):
        return F.max(F.when((F.col("_lo") <= index) & (index < F.col("_hi")), F.col("_v")))

    picks = []
    for i, q in enumerate(qs):
        exact = F.lit(float(q)) * (F.col("n") - 1)
        picks += [value_at(F.floor(exact)).alias(f"_a{i}"), value_at(F.ceil(exact)).alias(f"_b{i}")]
    picked = ranked.groupBy(*by, "n").agg(*picks)

    def interpolate(i, q):
        exact = F.lit(float(q)) * (F.col("n") - 1)
        return F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (exact - F.floor(exact))

    return picked.select(*by, "n", F.array(*[interpolate(i, q) for i, q in enumerate(qs)]).alias("q"))
