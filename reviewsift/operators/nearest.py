"""Exact nearest-neighbour distances: noise to core rows, and k-distance of every row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewsift.operators.dbscan import BLOCK_ROWS, BatchClustering, Clustering
from reviewsift.operators.features import Z_COLUMNS, apply_scale, feature_matrix, fit_scale
from reviewsift.operators.grid import (
    BOX_COLUMNS, MARGIN, REP_COLUMNS, distance_to_box, squared_distance, summarize,
)
from reviewsift.operators.kdtree import LEAF, kth_distances
from reviewsift.operators.ordering import join_hot, small, with_position
from reviewsift.operators.quantiles import exact_quantiles, melt
from reviewsift.session import materialize

DISTANCE_DIGITS = 9  # distances are rounded to this before ranking, so rounding noise is a tie


# --- noise to nearest core row -----------------------------------------------------------


def _core_cells(c: Clustering) -> DataFrame:
    """Boxes of the core rows per fine cell, with the cell index on every axis."""
    kept = ["cell", "rows", "first_row", *BOX_COLUMNS, *REP_COLUMNS]
    boxes = summarize(c.core_rows, "cell").select(*kept).unionByName(c.dense.select(*kept))
    return boxes.select(
        c.grid.batch_of("cell").alias("batch_id"), F.pmod("cell", F.lit(4)).alias("flags"),
        *[c.grid.index_of("cell", n).alias(f"i{n}") for n in range(len(c.grid.axes))], *kept)


def _coarser(nodes: DataFrame, axes: int, shift: int) -> DataFrame:
    """Merge cells ``2**shift`` per axis; the box covers all, the representative is a real row."""
    keys = ["batch_id", "flags", *[f"i{n}" for n in range(axes)]]
    moved = nodes.withColumns({f"i{n}": F.shiftright(f"i{n}", shift) for n in range(axes)})
    return moved.groupBy(*keys).agg(
        F.min("first_row").alias("first_row"),
        *[F.min(f"lo_{z}").alias(f"lo_{z}") for z in Z_COLUMNS],
        *[F.max(f"hi_{z}").alias(f"hi_{z}") for z in Z_COLUMNS],
        *[F.min_by(f"rep_{z}", "first_row").alias(f"rep_{z}") for z in Z_COLUMNS],
    )


def _rep_distance(point: str, box: str) -> Column:
    total = None
    for z in Z_COLUMNS:
        d = F.col(f"{point}.{z}") - F.col(f"{box}.rep_{z}")
        total = d * d if total is None else total + d * d
    return total


def nearest_core(c: Clustering, step: int = 1) -> DataFrame:
    """``(row_id, batch_id, min_dist)``: distance of each noise row to the nearest core row.

    Top-down search over nested boxes of core rows: each noise row keeps the boxes that can
    still hold its nearest core row (nearer than the closest representative seen so far) and
    replaces them by their children, until fine cells are left; only their rows are compared.
    A noise row in a batch without core rows gets a null distance. Batches settled by one task each have the distances.
    """
    if isinstance(c, BatchClustering):
        return c.nearest_core()
    axes = range(len(c.grid.axes))
    cells = materialize(_core_cells(c), "core_cells")
    depth = math.ceil(math.log2(max([2, *c.grid.cells])) / step)
    # the cells are few beside the rows, so every level is grouped from them directly
    levels = [cells] + [_coarser(cells, len(axes), step * n) for n in range(1, depth + 1)]

    # equal noise rows are searched once
    places = materialize(
        c.noise.groupBy("batch_id", *Z_COLUMNS).agg(F.min("row_id").alias("place")), "noise_places")
    parent_of = lambda: [F.shiftright(f"i{n}", step).alias(f"i{n}") for n in axes]
    # the top level has one box per batch and flag combination
    top = small(materialize(levels[-1].select("batch_id", "flags", *[f"i{n}" for n in axes]), "top_boxes"))
    search = places.join(top, "batch_id").withColumn("best", F.lit(float("inf")))
    per_row = Window.partitionBy("place")
    for level in reversed(levels[:-1]):
        bottom = level is levels[0]
        keys = ["batch_id", "flags", *[f"i{n}" for n in axes]]
        children = materialize(level.select(
            "batch_id", "flags", *parent_of(), *[F.col(f"i{n}").alias(f"j{n}") for n in axes],
            *BOX_COLUMNS, *REP_COLUMNS, *(["cell", "rows"] if bottom else [])), "child_boxes")
        near, _ = distance_to_box("p", "b")
        # coarse levels have few boxes, each wanted by many places: they are broadcast. Fine ones have
        # many keys. A child beyond the best so far goes inside the join, before anything is shuffled
        search = (
            search.alias("p").join(small(children).alias("b"), keys)
            .where(near <= F.col("p.best") * (1 + MARGIN))
            .select("p.place", "batch_id", "flags", *[f"p.{z}" for z in Z_COLUMNS],
                    *[F.col(f"b.j{n}").alias(f"i{n}") for n in axes],
                    *(["b.cell", "b.rows"] if bottom else []),
                    near.alias("near"), F.least("p.best", _rep_distance("p", "b")).alias("best"))
            .withColumn("best", F.min("best").over(per_row))
            .where(F.col("near") <= F.col("best") * (1 + MARGIN))
        )
    leaves = materialize(search.select("place", "cell", "rows", "best", *Z_COLUMNS), "leaves")
    in_sparse = (
        leaves.alias("p").join(c.core_rows.select("cell", *Z_COLUMNS).alias("q"), "cell")
        .select("p.place", squared_distance("p", "q").alias("d2"))
    )
    dense = leaves.join(c.dense.select("cell"), "cell", "left_semi")
    blocks = dense.withColumn("block", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("rows") - 1) / BLOCK_ROWS).cast("int"))))
    in_dense = (
        blocks.alias("p").join(c.rows_of(dense.select("cell", "rows").distinct()).alias("q"),
                               ["cell", "block"])
        .select("p.place", squared_distance("p", "q").alias("d2"))
    )
    nearest = in_sparse.unionByName(in_dense).groupBy("place").agg(F.min("d2").alias("d2"))
    found = places.join(nearest, "place", "left").drop("place")
    rows = c.noise.select("row_id", "batch_id", *Z_COLUMNS)
    return rows.join(found, ["batch_id", *Z_COLUMNS]).select("row_id", "batch_id", F.sqrt("d2").alias("min_dist"))


def rank_anomalies(c: Clustering) -> DataFrame:
    """Noise rows with ``min_dist`` and 1-based ranks, farthest first, inside their batch and
    over all batches in turn. Rows without a distance keep row order.
    """
    far = F.desc(F.coalesce(F.round("min_dist", DISTANCE_DIGITS), F.lit(0.0)))
    overall = with_position(nearest_core(c), [F.asc("batch_id"), far, F.asc("row_id")], position="rank")
    first = overall.groupBy("batch_id").agg(F.min("rank").alias("_first"))
    return overall.join(first, "batch_id").select(
        "row_id", "batch_id", "min_dist", (F.col("rank") + 1).alias("rank"),
        (F.col("rank") - F.col("_first") + 1).alias("batch_rank"))


# --- k-distance --------------------------------------------------------------------------


def k_distances(df: DataFrame, k: int = 16, leaf: int = LEAF) -> DataFrame:
    """``(row_id, k_distance)``: distance of every row to its k-th neighbour, itself included.

    Equal rows collapse to one weighted point; the points' neighbours are found over a k-d tree of
    partitions (``kdtree``). Null where there are fewer than ``k`` rows.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    features = materialize(feature_matrix(df, complete=True), "knn_features")
    if features.isEmpty():
        return features.select("row_id", F.lit(None).cast("double").alias("k_distance"))
    scaled = apply_scale(features, fit_scale(features))
    points = materialize(
        scaled.groupBy(*Z_COLUMNS).agg(F.count("*").alias("copies"), F.min("row_id").alias("vid")), "knn_points")
    known = kth_distances(points, Z_COLUMNS, k, leaf)
    result = materialize(
        points.join(known, "vid", "left")
        .select(*Z_COLUMNS, "copies", F.sqrt("d2").alias("k_distance")), "knn_result")
    return join_hot(scaled.select("row_id", *Z_COLUMNS), result, Z_COLUMNS, "copies", "row_id",
                    how="inner").select("row_id", "k_distance")


def k_distance_curve(distances: DataFrame) -> DataFrame:
    """The k-distances in ascending order with their 0-based position."""
    known = distances.where(F.col("k_distance").isNotNull())
    return with_position(known, [F.asc("k_distance"), F.asc("row_id")]).select("pos", "row_id", "k_distance")


def k_distance_stats(distances: DataFrame) -> DataFrame:
    """Min, max and linear percentiles of the k-distance curve."""
    names = ["p25", "p50", "p75", "p90", "p95", "p99"]
    q = exact_quantiles(melt(distances, ["k_distance"]), [0.0, 1.0, .25, .5, .75, .9, .95, .99])
    return q.select(*[F.col("q")[i].alias(n) for i, n in enumerate(["min", "max", *names])])
