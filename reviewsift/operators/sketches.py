"""Mergeable sketches of a table's profile: distinct values and quantiles.

Each slice of a table (a day, a category, a file) keeps one row of sketches. Slices are merged instead of being
read again: distinct values that slices share count once, quantiles are those of all rows together. Errors are bounded in
probability: a HyperLogLog of ``2**k`` registers is off by ``distinct_error(k)`` as its standard deviation, a KLL
sketch of size 200 by about 1.7 % of the ranks in 99 of 100 cases.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGISTERS = 12
RANK_ERROR = 0.0175


def distinct_error(registers: int = REGISTERS) -> float:
    """Relative standard error of a distinct count."""
    return 1.04 / math.sqrt(2 ** registers)


def _hashable(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    return F.col(name) if kind in ("int", "bigint", "string", "binary") else F.col(name).cast("string")


def slice_sketches(df: DataFrame, slices: Sequence[str], distinct: Sequence[str], quantiles: Sequence[str] = (),
                   registers: int = REGISTERS) -> DataFrame:
    """A row per slice: ``rows``, ``hll_<column>`` of the distinct and ``kll_<column>`` of the numeric columns.

    Nulls (and quantiles' NaN) are not counted. The sketches are built in part by each task before anything is shuffled.
    """
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return df.groupBy(*slices).agg(
        F.count("*").alias("rows"),
        *[F.hll_sketch_agg(_hashable(df, c), F.lit(registers)).alias(f"hll_{c}") for c in distinct],
        *[F.kll_sketch_agg_double(number(c)).alias(f"kll_{c}") for c in quantiles])


def merge_sketches(sketches: DataFrame, slices: Sequence[str] = ()) -> DataFrame:
    """Sketches of coarser ``slices`` (of everything by default) from those of finer ones."""
    merged = [F.sum("rows").alias("rows")]
    for name in sketches.columns:
        if name.startswith("hll_"):
            merged.append(F.hll_union_agg(name).alias(name))
        elif name.startswith("kll_"):
            merged.append(F.kll_merge_agg_double(name).alias(name))
    return sketches.groupBy(*slices).agg(*merged)


def sketch_profile(sketches: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``rows``, ``distinct_<column>`` and ``quantiles_<column>`` (an array) of each row of sketches."""
    out = [c for c in sketches.columns if not c.startswith(("hll_", "kll_"))]
    points = F.array(*[F.lit(float(q)) for q in quantiles])
    return sketches.select(
        *out,
        *[F.hll_sketch_estimate(c).alias(f"distinct_{c[4:]}") for c in sketches.columns if c.startswith("hll_")],
        *[F.kll_sketch_get_quantile_double(c, points).alias(f"quantiles_{c[4:]}") for c in sketches.columns if c.startswith("kll_")])
