"""Exact distributed DBSCAN on a grid.

A cell whose rows all lie within the radius of each other and that holds ``min_samples`` of
them is *dense*: all its rows are core rows of one cluster, so its inner pairs are never made.
What remains (*sparse* rows, fewer than ``min_samples`` per cell) is bounded per tile, so the
neighbour join of sparse rows has no hot key however the data is distributed. Sparse rows meet
dense cells through the cell's box first, and through its rows only where the box leaves the
answer open.

Batches of a bounded number of rows are settled by one task each, so no row is sent to its neighbour tiles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsift.operators.components import connected_components
from reviewsift.operators.features import Z_COLUMNS, Scale, apply_scale, feature_matrix, fit_scale
from reviewsift.operators.grid import (
    BOX_COLUMNS, MARGIN, REP_COLUMNS, Grid, box_diagonal, box_distances, distance_to_box,
    prepare_points, rep_distance, squared_distance, summarize,
)
from reviewsift.operators.kdtree import ball_counts
from reviewsift.operators.ordering import drop_members, join_hot, with_position
from reviewsift.session import materialize

BLOCK_ROWS = 100_000  # rows of one dense cell per task when its rows are needed
PAIR_LIMIT = 10_000_000  # row pairs of two cells settled in one join
WHOLE_BATCH = 10_000  # rows of a batch that one task compares with each other
LEAF_POINTS = 32  # different points of a box that is compared point by point where a sphere cuts it


@dataclass
class Clustering:
    """Stored intermediate tables of one run; every result is derived from them on demand."""

    eps: float
    min_samples: int
    scale: Scale
    grid: Grid
    points: DataFrame  # row_id, batch_id, cell, tile, z_*
    dense: DataFrame  # dense cells: cell, tile, rows, first_row, box, representative
    sparse: DataFrame  # rows outside dense cells

    # --- who is a core row -----------------------------------------------------------

    @cached_property
    def _dense_meet(self) -> DataFrame:
        """``(row_id, cell, rows, first_row, inside)``: sparse rows and dense cells whose box is
        within eps; ``inside`` if all of the box is.
        """
        limit = self.eps * self.eps
        near, far = distance_to_box("p", "d")
        return materialize(
            self.sparse.alias("p").join(shuffled(self.grid.near_tiles(self.dense)).alias("d"), "tile")
            .where(near <= limit * (1 + MARGIN))
            .select("p.row_id", F.col("d.cell").alias("cell"), "d.rows", "d.first_row",
                    (far <= limit * (1 - MARGIN)).alias("inside")), "dense_meet")

    @cached_property
    def _counted(self) -> DataFrame:
        """Sparse rows with ``known``: neighbours in boxes that are wholly within eps and, where
        these are too few to settle the row, among the sparse rows.
        """
        sure = self._dense_meet.where("inside").groupBy("row_id").agg(F.sum("rows").alias("sure"))
        rows = materialize(
            self.sparse.join(sure, "row_id", "left").withColumn("sure", F.coalesce("sure", F.lit(0))), "sure")
        here = self.sparse.select("tile", *Z_COLUMNS)
        thin = rows.where(F.col("sure") < self.min_samples).select("row_id", "tile", *Z_COLUMNS)
        among = (
            self.grid.near_tiles(thin).alias("p").join(shuffled(here).alias("q"), "tile")
            .where(squared_distance("p", "q") <= F.lit(self.eps * self.eps))
            .groupBy("p.row_id").agg(F.count("*").alias("among"))
        )
        return materialize(
            rows.join(among, "row_id", "left")
            .withColumn("known", F.col("sure") + F.coalesce("among", F.lit(0))).drop("sure", "among"),
            "counted")

    @cached_property
    def dense_links(self) -> DataFrame:
        """``(row_id, first_row, rows_near, inside)``: rows not yet settled within eps of a dense
        cell. Cells whose box does not decide are compared row by row.
        """
        unsettled = self._counted.where(F.col("known") < self.min_samples)
        meet = self._dense_meet.join(unsettled.select("row_id"), "row_id", "left_semi")
        inside = meet.where("inside").select("row_id", "first_row", F.col("rows").alias("rows_near"), "inside")
        unsure = materialize(
            meet.where(~F.col("inside")).join(unsettled.select("row_id", *Z_COLUMNS), "row_id"), "unsure")
        targets = self.rows_of(unsure.select("cell", "rows").distinct())
        blocks = unsure.withColumn("block", F.explode(F.sequence(
            F.lit(0), F.floor((F.col("rows") - 1) / BLOCK_ROWS).cast("int"))))
        counted = (
            blocks.alias("p").join(targets.alias("q"), ["cell", "block"])
            .where(squared_distance("p", "q") <= F.lit(self.eps * self.eps))
            .groupBy("p.row_id", "p.first_row").agg(F.sum("q.copies").alias("rows_near"))
            .select("row_id", "first_row", "rows_near", F.lit(False).alias("inside"))
        )
        return materialize(inside.unionByName(counted), "dense_links")

    def rows_of(self, cells: DataFrame) -> DataFrame:
        """Distinct points of the given dense cells ``(cell, rows)``, with copies, in blocks.

        Equal points collapse before the shuffle; large cells are cut into blocks of about
        ``BLOCK_ROWS``.
        """
        wanted = materialize(cells, "wanted_cells")
        return (
            join_hot(self.points, wanted, ["cell"], "rows", "row_id", how="inner")
            .groupBy("cell", "rows", *Z_COLUMNS)
            .agg(F.count("*").alias("copies"), F.min("row_id").alias("row_id"))
            .withColumn("block", F.pmod(
                F.xxhash64(*Z_COLUMNS), F.floor((F.col("rows") - 1) / BLOCK_ROWS) + 1).cast("int"))
        )

    @cached_property
    def sparse_core(self) -> DataFrame:
        """Sparse rows with ``is_core``; neighbours are counted until they settle it."""
        more = self.dense_links.where(~F.col("inside")).groupBy("row_id").agg(F.sum("rows_near").alias("more"))
        return materialize(
            self._counted.join(more, "row_id", "left")
            .withColumn("is_core", F.col("known") + F.coalesce("more", F.lit(0)) >= self.min_samples)
            .drop("known", "more"), "sparse_core")

    @cached_property
    def core_rows(self) -> DataFrame:
        """All core rows outside dense cells."""
        return self.sparse_core.where("is_core")

    def core_flags(self) -> DataFrame:
        """``(row_id, is_core)`` for every row; counts only as far as the flag needs."""
        core = self.sparse_core.select("row_id", "is_core")
        return self.points.select("row_id").join(core, "row_id", "left").select(
            "row_id", F.coalesce("is_core", F.lit(True)).alias("is_core"))

    def neighbour_counts(self) -> DataFrame:
        """``(row_id, neighbours, is_core)``: the exact number of rows within eps of every row, itself included.

        Equal rows collapse to a weighted point; points are packed into boxes, which count whole boxes within eps
        and compare only those at the rim point by point (``kdtree.ball_counts``).
        """
        points = materialize(
            self.points.groupBy("batch_id", "cell", *Z_COLUMNS)
            .agg(F.count("*").alias("copies")).withColumn("vid", F.monotonically_increasing_id()), "different_points")
        counts = ball_counts(points, Z_COLUMNS, self.eps * self.eps, LEAF_POINTS).withColumnRenamed("n", "neighbours")
        known = materialize(
            points.join(counts, "vid").select("cell", *Z_COLUMNS, "copies", "neighbours"), "neighbour_counts")
        return join_hot(self.points, known, ["cell", *Z_COLUMNS], "copies", "row_id", how="inner").select(
            "row_id", "neighbours", (F.col("neighbours") >= self.min_samples).alias("is_core"))

    # --- noise -----------------------------------------------------------------------

    @cached_property
    def noise(self) -> DataFrame:
        """Sparse rows that are not core and have no core row within eps."""
        open_rows = self.sparse_core.where(~F.col("is_core")).join(
            self.dense_links.select("row_id"), "row_id", "left_anti")
        reached = (
            self.grid.near_tiles(open_rows.select("row_id", "tile", *Z_COLUMNS)).alias("p")
            .join(shuffled(self.core_rows.select("tile", *Z_COLUMNS)).alias("q"), "tile")
            .where(squared_distance("p", "q") <= F.lit(self.eps * self.eps))
            .select("p.row_id").distinct()
        )
        return materialize(
            open_rows.join(reached, "row_id", "left_anti")
            .select("row_id", "batch_id", "cell", *Z_COLUMNS), "noise")

    # --- clusters --------------------------------------------------------------------

    @cached_property
    def _core_nodes(self) -> DataFrame:
        """Sparse core rows with ``node``: the core rows of a cell are one graph node.

        Should rounding leave a cell wider than eps, its rows stay separate nodes.
        """
        core = self.core_rows
        fits = summarize(core, "cell").select(
            "cell", F.col("first_row").alias("_first"),
            (box_diagonal() <= self.eps * self.eps).alias("_fits"))
        return materialize(
            core.join(fits, "cell")
            .withColumn("node", F.when(F.col("_fits"), F.col("_first")).otherwise(F.col("row_id")))
            .select("row_id", "tile", "node", *Z_COLUMNS), "core_nodes")

    @cached_property
    def _border_links(self) -> DataFrame:
        """``(row_id, node)``: rows that are not core, with the core nodes within eps."""
        outer = self.sparse_core.where(~F.col("is_core")).select("row_id", "tile", *Z_COLUMNS)
        among = (
            self.grid.near_tiles(outer).alias("p").join(shuffled(self._core_nodes).alias("q"), "tile")
            .where(squared_distance("p", "q") <= F.lit(self.eps * self.eps))
            .select("p.row_id", "q.node")
        )
        to_dense = self.dense_links.join(outer.select("row_id"), "row_id", "left_semi").select(
            "row_id", F.col("first_row").alias("node"))
        return materialize(among.unionByName(to_dense).distinct(), "border_links")

    @cached_property
    def components(self) -> DataFrame:
        """``(node, component)``: core nodes, component = least core row of the cluster.

        A node is the core rows of one cell, so the graph has cells, not rows.
        """
        kept = ["node", "tile", *BOX_COLUMNS, *REP_COLUMNS]
        nodes = materialize(
            summarize(self._core_nodes, "node", "tile").select(*kept)
            .unionByName(self.dense.withColumn("node", F.col("first_row")).select(*kept)), "nodes")
        sure, open_pairs = self._node_pairs(nodes)
        parts = materialize(
            nodes.select("node").join(connected_components(sure), "node", "left")
            .withColumn("component", F.coalesce("component", "node")), "components")
        # only pairs that would join two components still matter
        side = lambda n: parts.select(F.col("node").alias(n), F.col("component").alias(f"c{n}"))
        undecided = materialize(
            open_pairs.join(side("u"), "u").join(side("v"), "v")
            .where(F.col("cu") != F.col("cv")).select("u", "v"), "undecided")
        touching = self._touching(undecided)
        if touching is None:
            return parts
        bridges = (
            touching.join(side("u"), "u").join(side("v"), "v")
            .select(F.col("cu").alias("u"), F.col("cv").alias("v"))
        )
        merged = connected_components(bridges).select(
            F.col("node").alias("component"), F.col("component").alias("merged"))
        return materialize(
            parts.join(merged, "component", "left")
            .select("node", F.coalesce("merged", "component").alias("component")), "components")

    def _node_pairs(self, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs of nodes that surely touch, and pairs their boxes cannot decide."""
        limit = self.eps * self.eps
        near, far = box_distances("a", "b")
        met = (
            self.grid.near_tiles(nodes, half=True).alias("a").join(shuffled(nodes).alias("b"), "tile")
            .where((~F.col("home") | (F.col("a.node") < F.col("b.node"))) & (near <= limit * (1 + MARGIN)))
            .select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"),
                    (F.least(far * (1 + MARGIN), rep_distance("a", "b")) <= limit).alias("sure"))
        )
        met = materialize(met, "node_pairs")
        return met.where("sure").select("u", "v"), met.where(~F.col("sure")).select("u", "v")

    def _node_rows(self, nodes: DataFrame) -> DataFrame:
        """``(node, row_id, z_*)``: the different points of the given nodes."""
        sparse = self._core_nodes.join(nodes, "node", "left_semi").select("node", "row_id", *Z_COLUMNS)
        cells = self.dense.join(nodes.withColumnRenamed("node", "first_row"), "first_row", "left_semi")
        dense = self.rows_of(cells.select("cell", "rows")).join(
            cells.select("cell", F.col("first_row").alias("node")), "cell")
        return materialize(sparse.unionByName(dense.select("node", "row_id", *Z_COLUMNS)), "node_rows")

    def _touching(self, pairs: DataFrame) -> DataFrame | None:
        """Of the undecided pairs of nodes, those with two rows within eps.

        Each round cuts both nodes of a pair four times finer per axis and settles the pieces
        by box and representative; small leftovers are settled row by row. Equal points are
        collapsed, so the pieces shrink to single points and the rounds end.
        """
        if pairs.isEmpty():
            return None
        limit, found = self.eps * self.eps, []
        rows = self._node_rows(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        side = lambda s: pairs.select("u", "v", F.lit(s).alias("side"), F.col(s).alias("node"))
        members = materialize(
            side("u").unionByName(side("v")).join(rows, "node")
            .select("u", "v", "side", "row_id", *Z_COLUMNS, F.lit(0).cast("long").alias("grp")), "members")
        cut = self.grid.side
        while True:
            cut /= 4
            members = members.withColumn("piece", F.struct(F.col("grp").alias("g"), *[
                F.floor(F.col(z) / F.lit(cut)).alias(f"c{i}") for i, z in enumerate(self.grid.axes)]))
            pieces = materialize(summarize(members, "u", "v", "side", "piece"), "pieces")
            of = lambda df, s: df.where(F.col("side") == s)
            near, far = box_distances("a", "b")
            met = materialize(
                of(pieces, "u").alias("a").join(of(pieces, "v").alias("b"), ["u", "v"])
                .where(near <= limit * (1 + MARGIN))
                .select("u", "v", F.col("a.piece").alias("piece_u"), F.col("b.piece").alias("piece_v"),
                        (F.col("a.rows") * F.col("b.rows")).alias("cost"),
                        (F.least(far * (1 + MARGIN), rep_distance("a", "b")) <= limit).alias("sure")),
                "piece_pairs")
            hit = met.where("sure").select("u", "v").distinct()
            left = met.where(~F.col("sure")).join(hit, ["u", "v"], "left_anti")
            end = lambda s: of(members, s).select(
                "u", "v", F.col("piece").alias(f"piece_{s}"), F.struct(*Z_COLUMNS).alias(f"z_{s}"))
            apart = reduce(lambda x, y: x + y, [
                (F.col(f"z_u.{z}") - F.col(f"z_v.{z}")) * (F.col(f"z_u.{z}") - F.col(f"z_v.{z}")) for z in Z_COLUMNS])
            settled = (
                left.where(F.col("cost") <= PAIR_LIMIT)
                .join(end("u"), ["u", "v", "piece_u"]).join(end("v"), ["u", "v", "piece_v"])
                .where(apart <= F.lit(limit)).select("u", "v").distinct()
            )
            hit = materialize(hit.unionByName(settled).distinct(), "touching")
            found.append(hit)
            rest = materialize(
                left.where(F.col("cost") > PAIR_LIMIT).join(hit, ["u", "v"], "left_anti"), "rest")
            if rest.isEmpty():
                return reduce(DataFrame.unionByName, found).distinct()
            keep = rest.select("u", "v", F.explode(F.array(
                F.struct(F.lit("u").alias("side"), F.col("piece_u").alias("piece")),
                F.struct(F.lit("v").alias("side"), F.col("piece_v").alias("piece")))).alias("k"))
            first = pieces.select("u", "v", "side", "piece", F.col("first_row").alias("grp"))
            keys = ["u", "v", "side", "piece"]
            members = materialize(
                members.drop("grp").join(keep.select("u", "v", "k.*").distinct().join(first, keys), keys)
                .drop("piece"), "members")

    @cached_property
    def cluster_ids(self) -> DataFrame:
        """``(component, cluster)``: 0, 1, ... by least core row, per batch."""
        least = self.components.select("component").distinct().withColumnRenamed("component", "row_id")
        batches = least.join(self.points.select("row_id", "batch_id"), "row_id")
        return with_position(batches, [F.col("row_id").asc()], within=["batch_id"], position="cluster").select(
            F.col("row_id").alias("component"), F.col("cluster").cast("int").alias("cluster"))

    def labels(self) -> DataFrame:
        """``(row_id, batch_id, kind, cluster)`` for every row; noise is -1.

        A border row gets the least label among the clusters it touches.
        """
        named = materialize(self.components.join(self.cluster_ids, "component").select("node", "cluster"),
                            "named")
        core = self._core_nodes.join(named, "node").select("row_id", "cluster", F.lit("core").alias("kind"))
        border = (
            self._border_links.join(named, "node")
            .groupBy("row_id").agg(F.min("cluster").alias("cluster"))
            .withColumn("kind", F.lit("border"))
        )
        outside = (
            self.sparse_core.select("row_id", "batch_id")
            .join(core.unionByName(border), "row_id", "left")
            .select("row_id", "batch_id", F.coalesce("kind", F.lit("noise")).alias("kind"),
                    F.coalesce("cluster", F.lit(-1)).alias("cluster"))
        )
        cells = materialize(
            self.dense.join(named.withColumnRenamed("node", "first_row"), "first_row")
            .select("cell", "rows", "cluster"), "dense_labels")
        inside = join_hot(self.points, cells, ["cell"], "rows", "row_id", how="inner").select(
            "row_id", "batch_id", F.lit("core").alias("kind"), "cluster")
        return outside.unionByName(inside)


def _settle_batch(limit: float, min_samples: int, apart: bool) -> Callable[[pa.Table], pa.Table]:
    """Adds ``is_core``, ``is_noise`` and ``d2``, the squared distance of a row that is not core to the nearest core row, to
    the rows of a batch. ``apart`` if rows that differ in a flag are farther apart than the radius. Made here, so it
    reaches the tasks by value.
    """
    columns, reach, step = Z_COLUMNS, limit ** 0.5 * (1 + MARGIN), 256

    def squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        total = np.zeros((len(p), len(q)))
        for i in range(p.shape[1]):  # in feature order, as in SQL
            d = p[:, None, i] - q[None, :, i]
            total += d * d
        return total

    def counted(z: np.ndarray) -> np.ndarray:
        axis = np.ptp(z, axis=0).argmax()
        order = np.argsort(z[:, axis], kind="stable")
        z, out = z[order], np.zeros(len(z), np.int64)
        for low in range(0, len(z), step):
            part = z[low:low + step]
            a, b = np.searchsorted(z[:, axis], (part[0, axis] - reach, part[-1, axis] + reach))
            out[order[low:low + step]] = (squares(part, z[a:b]) <= limit).sum(1)
        return out

    def settle(rows: pa.Table) -> pa.Table:
        z = np.column_stack([rows[c].to_numpy() for c in columns])
        number, n = rows["flags"].to_numpy() if apart else np.zeros(len(z), np.int64), np.zeros(len(z), np.int64)
        for flags in np.unique(number):
            some = np.flatnonzero(number == flags)
            n[some] = counted(z[some])
        core = n >= min_samples
        nearest, others = np.full(len(z), np.inf), np.flatnonzero(~core)
        for low in range(0, len(others) if core.any() else 0, step):
            some = others[low:low + step]
            nearest[some] = squares(z[some], z[core]).min(1)
        noise = ~core & (nearest > limit)
        return rows.append_column("is_core", pa.array(core)).append_column("is_noise", pa.array(noise)).append_column(
            "d2", pa.array(nearest, mask=np.isinf(nearest)))

    return settle


class BatchClustering(Clustering):
    """A run whose batches are settled by one task each: ``points`` has ``is_core``, ``is_noise`` and ``d2``, and no cell is
    taken as dense.
    """

    @cached_property
    def sparse_core(self) -> DataFrame:
        return self.points.drop("is_noise", "d2")

    @cached_property
    def dense_links(self) -> DataFrame:
        return self.points.where("false").select(
            "row_id", F.col("row_id").alias("first_row"), F.lit(0).cast("long").alias("rows_near"), F.lit(True).alias("inside"))

    @cached_property
    def noise(self) -> DataFrame:
        return self.points.where("is_noise").select("row_id", "batch_id", "cell", *Z_COLUMNS)

    def nearest_core(self) -> DataFrame:
        """``(row_id, batch_id, min_dist)`` of the noise rows; null in a batch without core rows."""
        return self.points.where("is_noise").select("row_id", "batch_id", F.sqrt("d2").alias("min_dist"))


def shuffled(df: DataFrame) -> DataFrame:
    """Join side that is to be shuffled: the work of these joins is in the pairs, and a small
    side sent to the few tasks that read the other one would leave most cores idle.
    """
    return df.hint("merge")


def with_batches(df: DataFrame, batch_size: int | None) -> DataFrame:
    """Add ``batch_id``: consecutive blocks of ``batch_size`` rows in row_id order."""
    if batch_size is None:
        return df.withColumn("batch_id", F.lit(0).cast("long"))
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    return with_position(df, [F.col("row_id").asc()]).withColumn(
        "batch_id", F.floor(F.col("pos") / F.lit(batch_size))).drop("pos")


def dbscan(df: DataFrame, eps: float = 0.6, min_samples: int = 12,
           batch_size: int | None = None) -> Clustering:
    """Cluster the six features of ``df``; scaled over the whole input, before batching.

    Rows with a null feature are left out first: they have no place, so they are in no result.
    """
    features = materialize(feature_matrix(df, complete=True), "features")
    scale = fit_scale(features)
    grid = Grid.fit(scale, eps, 1 + scale.rows // batch_size if batch_size else 1)
    placed = apply_scale(with_batches(features, batch_size), scale)
    if batch_size and batch_size <= WHOLE_BATCH and _unique(features, "row_id"):
        return _by_batch(placed, eps, min_samples, scale, grid)
    points = materialize(prepare_points(placed, grid), "points")
    dense = materialize(
        summarize(points, "cell", "tile")
        .where((F.col("rows") >= min_samples) & (box_diagonal() <= F.lit(eps * eps * (1 - MARGIN)))),
        "dense_cells")
    sparse = materialize(drop_members(points, dense, "cell", "rows"), "sparse")
    return Clustering(eps, min_samples, scale, grid, points, dense, sparse)


def _unique(df: DataFrame, key: str) -> bool:
    """Whether no row lacks the key or shares it with another."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).isEmpty()


def _by_batch(placed: DataFrame, eps: float, min_samples: int, scale: Scale, grid: Grid) -> BatchClustering:
    points = prepare_points(placed, grid).withColumn("flags", F.pmod("cell", F.lit(4)))
    schema = ", ".join(f"`{c}` {kind}" for c, kind in points.dtypes) + ", is_core boolean, is_noise boolean, d2 double"
    settle = _settle_batch(eps * eps, min_samples, grid.flips == (0,))
    points = materialize(points.groupBy("batch_id").applyInArrow(settle, schema).drop("flags"), "points")
    dense = summarize(points.where("false"), "cell", "tile")
    return BatchClustering(eps, min_samples, scale, grid, points, dense, points.drop("is_core", "is_noise", "d2"))
