"""Exact k-th neighbour distances and neighbour counts over a k-d tree of partitions.

A sample of the points is cut at medians into leaves of about ``LEAF`` points each; the cuts place every point in a
leaf, whose points lie in one task. There each point finds its nearest within its leaf, which bounds its distance.
Only a point whose ball of that radius meets the box of another leaf is sent on to it, for the points of that
leaf inside the ball; whatever the sample was, the result is exact. The tree and the boxes are as many rows as
leaves, at most ``LEAVES``.

Counts within a radius pack each leaf's points into boxes of a few points. Boxes meet chunks of leaves; there a box
of points counts the boxes that lie wholly within the radius of all its points by their weight, and only boxes at
the rim are compared point by point.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsift.operators.ordering import small
from reviewsift.session import materialize

#: Points of a leaf, about; leaves at most (larger leaves beyond); sampled points for each leaf.
LEAF, LEAVES, SAMPLED = 2_000, 50_000, 20
#: Visits of a leaf that one task takes, about.
VISITS = 20_000
#: Distances computed at once.
CELLS = 1_000_000
#: Leaves of a chunk at most; points that a task compares with a chunk, about; distances of a block that stays in cache.
CHUNK, COMPARED, BLOCK = 25, 250_000, 32_768
#: Balls and boxes are compared with this relative margin, so rounding never hides a neighbour.
MARGIN = 1e-9


@dataclass
class Tree:
    """Cuts as arrays: inner node ``i`` sends a point left if its ``axis[i]`` is at most ``at[i]``; a child below zero is
    leaf ``-1 - child``."""

    axis: list[int] = field(default_factory=list)
    at: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    leaves: int = 0

    @classmethod
    def of(cls, sample: np.ndarray, leaves: int) -> "Tree":
        tree = cls()
        tree._grow(sample, leaves)
        return tree

    def _grow(self, sample: np.ndarray, leaves: int) -> int:
        """Number of the node made for ``sample``; cuts the widest axis between two of its values, near the median."""
        spread = np.ptp(sample, axis=0) if len(sample) > 1 else np.zeros(sample.shape[1])
        if leaves <= 1 or not spread.max() > 0:
            self.leaves += 1
            return -self.leaves
        axis = int(spread.argmax())
        values = np.sort(sample[:, axis])
        at = values[(len(values) - 1) // 2]
        if at == values[-1]:
            at = values[values < at][-1]
        node = len(self.axis)
        for column, v in ((self.axis, axis), (self.at, float(at)), (self.left, 0), (self.right, 0)):
            column.append(v)
        low = sample[:, axis] <= at
        share = min(leaves - 1, max(1, round(leaves * low.mean())))
        self.left[node] = self._grow(sample[low], share)
        self.right[node] = self._grow(sample[~low], leaves - share)
        return node

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), 0 if self.axis else -1)
        if not self.axis:
            return np.zeros(len(points), np.int64)
        axis, cut, left, right = (np.array(c) for c in (self.axis, self.at, self.left, self.right))
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            at[inner] = np.where(points[inner, axis[node]] <= cut[node], left[node], right[node])
        return -1 - at


def _pairwise(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    return sum((q[:, n, None] - t[None, :, n]) ** 2 for n in range(q.shape[1]))


def _nearest(q: np.ndarray, t: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of the up to ``k`` nearest ``t`` of each ``q``, ascending, and their copies."""
    keep, step = min(k, len(t)), max(1, CELLS // max(1, len(t)))
    dists, copies = np.empty((len(q), keep)), np.empty((len(q), keep), np.int64)
    for start in range(0, len(q), step):
        d2 = _pairwise(q[start:start + step], t)
        found = np.argpartition(d2, keep - 1, axis=1)[:, :keep]
        near = np.take_along_axis(d2, found, axis=1)
        order = np.argsort(near, axis=1)
        dists[start:start + step] = np.take_along_axis(near, order, axis=1)
        copies[start:start + step] = w[np.take_along_axis(found, order, axis=1)]
    return dists, copies


def _reaches(dists: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """Squared distance at which the copies, nearest first, reach ``k``; infinite where they do not."""
    seen = np.cumsum(copies, axis=1) >= k
    first = seen.argmax(axis=1)
    return np.where(seen[:, -1], dists[np.arange(len(dists)), first], np.inf)


def _leaves(points: DataFrame, columns: list[str], n: int, wanted: int) -> Callable[..., Column]:
    """The leaf of a point, as a function of its columns, in a tree over a sample of the ``n`` points."""
    rate = min(1.0, 1.2 * wanted * SAMPLED / max(1, n))
    chosen = points.where(F.pmod(F.xxhash64("vid"), F.lit(1_000_000)) < int(math.ceil(rate * 1_000_000)))
    sample = chosen.select(*columns).limit(2 * LEAVES * SAMPLED).toPandas().to_numpy(np.float64)  # by a hash: any will do
    tree = Tree.of(sample, wanted if len(sample) else 1)

    @F.pandas_udf("long")
    def leaf_of(*z: pd.Series) -> pd.Series:
        return pd.Series(tree.leaf_of(np.column_stack([c.to_numpy(np.float64) for c in z])))

    return leaf_of


def kth_distances(points: DataFrame, columns: list[str], k: int, leaf: int = LEAF) -> DataFrame:
    """``(vid, d2)``: squared distance of each point to its ``k``-th neighbour, itself included.

    ``points(vid, copies, *columns)`` is a stored table of distinct points that count ``copies`` times. Points with
    fewer than ``k`` neighbours in the whole table have no row.
    """
    n = points.count()
    axes = len(columns)
    leaf_of = _leaves(points, columns, n, max(1, min(LEAVES, n // leaf)))
    placed = materialize(points.select("vid", "copies", *columns, leaf_of(*columns).alias("leaf")), "kd_points")
    sizes = placed.groupBy("leaf").agg(
        F.count("*").alias("n"), *[F.min(c).alias(f"lo_{i}") for i, c in enumerate(columns)],
        *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(columns)]).orderBy("leaf").toPandas()  # a row per leaf
    names = sizes["leaf"].to_numpy()
    low = sizes[[f"lo_{i}" for i in range(axes)]].to_numpy(np.float64)
    high = sizes[[f"hi_{i}" for i in range(axes)]].to_numpy(np.float64)

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        """Nearest within the leaf; ``on``: the other leaves that the ball meets."""
        z, w = rows[columns].to_numpy(np.float64), rows["copies"].to_numpy()
        here = int(np.searchsorted(names, rows["leaf"].iloc[0]))
        dists, copies = _nearest(z, z, w, k)
        d2 = _reaches(dists, copies, k)
        # boxes near enough to the leaf's own box come first, then each point's ball
        gap = np.maximum(np.maximum(low - high[here], low[here] - high), 0)
        near = np.flatnonzero((gap ** 2).sum(axis=1) <= d2.max() * (1 + MARGIN))
        near = near[near != here]
        on: list = [None] * len(z)
        step = max(1, CELLS // max(1, len(near)))
        for start in range(0, len(z) if len(near) else 0, step):
            part = z[start:start + step, None, :]
            away = (np.maximum(np.maximum(low[near] - part, part - high[near]), 0) ** 2).sum(axis=2)
            meets = away <= d2[start:start + step, None] * (1 + MARGIN)
            for i in np.flatnonzero(meets.any(axis=1)):
                on[start + i] = names[near[meets[i]]].tolist()
        sent = [o is not None for o in on]
        return pd.DataFrame({
            "vid": rows["vid"].to_numpy(), "d2": d2, "on": on,
            "dists": [d.tolist() if s else None for d, s in zip(dists, sent)],
            "copies": [c.tolist() if s else None for c, s in zip(copies, sent)],
            **{c: rows[c].to_numpy() for c in columns}})

    kinds = ", ".join(f"{c} double" for c in columns)
    local = materialize(placed.groupBy("leaf").applyInPandas(
        inside, f"vid long, d2 double, on array<long>, dists array<double>, copies array<long>, {kinds}"), "kd_local")
    visits = local.where("on is not null").select(
        "vid", F.col("d2").alias("reach"), *columns, F.explode("on").alias("leaf"))
    parts = small(materialize(visits.groupBy("leaf").agg(
        F.ceil(F.count("*") / VISITS).cast("int").alias("parts")), "kd_visits"))
    asked = visits.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int")).drop("parts")
    wanted_by = parts.select(F.col("leaf").alias("_leaf"), F.col("parts").alias("_parts"))
    offered = placed.join(wanted_by, placed["leaf"] == wanted_by["_leaf"]).select(
        F.col("_leaf").alias("leaf"), "copies", *[F.col(c).alias(c) for c in columns],
        F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"))

    def across(queries: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(targets):
            return pd.DataFrame({"vid": np.empty(0, "int64"), "d2": np.empty(0), "copies": np.empty(0, "int64")})
        dists, copies = _nearest(
            queries[columns].to_numpy(np.float64), targets[columns].to_numpy(np.float64), targets["copies"].to_numpy(), k)
        row, col = np.nonzero(dists <= queries["reach"].to_numpy()[:, None])
        return pd.DataFrame({"vid": queries["vid"].to_numpy()[row], "d2": dists[row, col], "copies": copies[row, col]})

    found = asked.groupBy("leaf", "part").cogroup(offered.groupBy("leaf", "part")).applyInPandas(
        across, "vid long, d2 double, copies long")
    own = local.where("on is not null").select("vid", F.explode(F.arrays_zip("dists", "copies")).alias("_e")).select(
        "vid", F.col("_e.dists").alias("d2"), F.col("_e.copies").alias("copies"))
    # the k nearest of all leaves together, per point that was sent on
    merged = found.unionByName(own).groupBy("vid").agg(
        F.sort_array(F.collect_list(F.struct("d2", "copies"))).alias("near"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("d2"))
    reached = F.aggregate("near", start, lambda a, e: F.when(a["seen"] >= k, a).otherwise(
        F.struct((a["seen"] + e["copies"]).alias("seen"), F.when(a["seen"] + e["copies"] >= k, e["d2"]).alias("d2"))))
    final = merged.select("vid", reached["d2"].alias("d2")).where("d2 is not null")
    return local.where("on is null and d2 < double('infinity')").select("vid", "d2").unionByName(final)


# --- neighbours within a radius ------------------------------------------------------------


def _bounds(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared least and greatest distance of one box to each of several; boxes are rows of ``lows`` and ``highs``."""
    gap = np.maximum(np.maximum(lows - high, low - highs), 0)
    return (gap ** 2).sum(axis=1), (np.maximum(highs - low, high - lows) ** 2).sum(axis=1)


def _unpacked(rows: pd.DataFrame, axes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and weights of the points, their coordinates by axis, and the first point of each box."""
    packs = [np.frombuffer(p, np.int64).reshape(axes + 2, -1) for p in rows["pack"]]
    table = np.concatenate(packs, axis=1)
    starts = np.cumsum([0, *[p.shape[1] for p in packs[:-1]]])
    return table[0], table[1], table[2:].view(np.float64), starts


def _close_copies(p: np.ndarray, q: np.ndarray, weights: np.ndarray, limit: float) -> np.ndarray:
    """Weight of the points ``q`` within ``limit`` of each ``p`` (columns are points), summed in column order.

    An axis on which all points agree adds zero and is left out, so the sums are those over all axes.
    """
    axes = [n for n in range(len(p)) if p[n].min() != p[n].max() or (q[n] != p[n, 0]).any()]
    found, step = np.zeros(p.shape[1]), max(1, BLOCK // p.shape[1])
    total, part = np.empty((p.shape[1], step)), np.empty((p.shape[1], step))
    for start in range(0, q.shape[1], step):
        here = slice(start, start + step)
        size = len(weights[here])
        d2, square = total[:, :size], part[:, :size]
        d2[:] = 0
        for n in axes:
            np.subtract(p[n][:, None], q[n, here], out=square)
            np.multiply(square, square, out=square)
            np.add(d2, square, out=d2)
        found += (d2 <= limit).astype(np.float64) @ weights[here]
    return found


def ball_counts(points: DataFrame, columns: list[str], limit: float, size: int, leaf: int = LEAF) -> DataFrame:
    """``(vid, n)``: copies of the points of its batch within the squared distance ``limit`` of each point, itself included.

    ``points(vid, batch_id, copies, *columns)`` is a stored table of points that are distinct within a batch. Boxes hold
    ``size`` points or fewer.
    """
    n, batches = points.agg(F.count("*"), F.countDistinct("batch_id")).first()
    axes, leaves = len(columns), max(1, min(LEAVES, n // max(1, batches) // leaf))
    leaf_of = _leaves(points, columns, n, leaves)
    per_chunk = max(1, min(CHUNK, leaves // 64))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        z = rows[columns].to_numpy(np.float64)
        boxes = -(-len(z) // size)
        box = Tree.of(z, boxes).leaf_of(z)
        order = np.argsort(box, kind="stable")
        cuts = np.flatnonzero(np.diff(box[order])) + 1
        table = np.vstack([rows["vid"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64),
                           np.ascontiguousarray(z.T).view(np.int64)])
        parts = [table[:, at] for at in np.split(order, cuts)]
        held = [part[2:].view(np.float64) for part in parts]
        return pd.DataFrame({
            "batch_id": rows["batch_id"].iloc[0], "leaf": rows["leaf"].iloc[0], "box": range(len(parts)),
            "points": [part.shape[1] for part in parts], "pack": [part.tobytes() for part in parts],
            **{f"lo_{i}": [h[i].min() for h in held] for i in range(axes)},
            **{f"hi_{i}": [h[i].max() for h in held] for i in range(axes)}})

    ends = [f"{side}_{i}" for i in range(axes) for side in ("lo", "hi")]
    boxes = materialize(
        points.withColumn("leaf", leaf_of(*columns)).groupBy("batch_id", "leaf").applyInPandas(
            packed, "batch_id long, leaf long, box long, points long, pack binary, " + ", ".join(f"{e} double" for e in ends))
        .withColumn("chunk", F.floor(F.col("leaf") / per_chunk)), "ball_boxes")
    chunks = materialize(boxes.groupBy("batch_id", "chunk").agg(
        *[(F.min if e.startswith("lo") else F.max)(e).alias(f"c{e}") for e in ends]), "ball_chunks")
    gaps = [F.greatest(F.col(f"lo_{i}") - F.col(f"chi_{i}"), F.col(f"clo_{i}") - F.col(f"hi_{i}"), F.lit(0.0)) for i in range(axes)]
    others = boxes.toDF(*boxes.columns)
    reached = others.drop("chunk").join(small(chunks), "batch_id").where(sum(g * g for g in gaps) <= limit * (1 + MARGIN))
    parts = small(materialize(reached.groupBy("batch_id", "chunk").agg(
        F.ceil(F.sum("points") / COMPARED).cast("int").alias("parts")), "ball_parts"))
    key = ["batch_id", "chunk", "part"]
    asked = boxes.join(parts, key[:2]).select(*key[:2], "pack", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    offered = reached.join(parts, key[:2]).select(
        *key[:2], "pack", F.pmod(F.xxhash64("leaf", "box"), F.col("parts")).cast("int").alias("part"))

    def counted(asking: pd.DataFrame, offering: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(offering):
            return pd.DataFrame({"vid": np.empty(0, "int64"), "n": np.empty(0, "int64")})
        vid, _, p, first = _unpacked(asking, axes)
        _, copies, q, starts = _unpacked(offering, axes)
        sizes, weights = np.diff([*starts, len(copies)]), copies.astype(np.float64)
        held = np.add.reduceat(copies, starts)
        lows, highs = np.minimum.reduceat(q, starts, axis=1).T, np.maximum.reduceat(q, starts, axis=1).T
        found = np.zeros(len(vid), np.int64)
        for a, b in zip(first, [*first[1:], len(vid)]):
            mine = np.ascontiguousarray(p[:, a:b])
            near, far = _bounds(mine.min(axis=1), mine.max(axis=1), lows, highs)
            inside = far <= limit * (1 - MARGIN)
            rim = np.flatnonzero(np.repeat(~inside & (near <= limit * (1 + MARGIN)), sizes))
            found[a:b] = held[inside].sum() + _close_copies(mine, q[:, rim], weights[rim], limit).astype(np.int64)
        return pd.DataFrame({"vid": vid, "n": found})

    return asked.groupBy(*key).cogroup(offered.groupBy(*key)).applyInPandas(counted, "vid long, n long").groupBy(
        "vid").agg(F.sum("n").alias("n"))
