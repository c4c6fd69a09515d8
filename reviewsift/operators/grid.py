"""Grid cells over the scaled features and exact distances to points and boxes."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsift.operators.features import Z_COLUMNS, Scale
from reviewsift.operators.ordering import whole
from reviewsift.schemas import FEATURES, FLAG_FEATURES

# Bounds computed from boxes are trusted only outside this relative margin; in between the
# points themselves decide, so rounding never changes a result.
MARGIN = 1e-9

BOX_COLUMNS = [f"{side}_{z}" for z in Z_COLUMNS for side in ("lo", "hi")]
REP_COLUMNS = [f"rep_{z}" for z in Z_COLUMNS]


def squared_distance(a: str, b: str) -> Column:
    """Squared distance of row aliases ``a`` and ``b``, summed in feature order."""
    diffs = [F.col(f"{a}.{z}") - F.col(f"{b}.{z}") for z in Z_COLUMNS]
    return reduce(add, [d * d for d in diffs])


def distance_to_box(point: str, box: str) -> tuple[Column, Column]:
    """Squared distance from a point to the nearest and to the farthest spot of a box."""
    near, far = [], []
    for z in Z_COLUMNS:
        p, lo, hi = F.col(f"{point}.{z}"), F.col(f"{box}.lo_{z}"), F.col(f"{box}.hi_{z}")
        gap = F.greatest(lo - p, p - hi, F.lit(0.0))
        reach = F.greatest(hi - p, p - lo)
        near.append(gap * gap)
        far.append(reach * reach)
    return reduce(add, near), reduce(add, far)


def box_distances(a: str, b: str) -> tuple[Column, Column]:
    """Squared least and greatest distance between two boxes."""
    near, far = [], []
    for z in Z_COLUMNS:
        alo, ahi, blo, bhi = (F.col(f"{x}.{s}_{z}") for x in (a, b) for s in ("lo", "hi"))
        gap = F.greatest(blo - ahi, alo - bhi, F.lit(0.0))
        reach = F.greatest(bhi - alo, ahi - blo)
        near.append(gap * gap)
        far.append(reach * reach)
    return reduce(add, near), reduce(add, far)


def rep_distance(a: str, b: str) -> Column:
    diffs = [F.col(f"{a}.rep_{z}") - F.col(f"{b}.rep_{z}") for z in Z_COLUMNS]
    return reduce(add, [d * d for d in diffs])


def box_diagonal() -> Column:
    sides = [F.col(f"hi_{z}") - F.col(f"lo_{z}") for z in Z_COLUMNS]
    return reduce(add, [s * s for s in sides])


def summarize(points: DataFrame, *keys: str, id_column: str = "row_id",
              weight: Column | None = None) -> DataFrame:
    """Rows, tight box, least id and the point with that id, per group of points."""
    return points.groupBy(*keys).agg(
        (F.count("*") if weight is None else F.sum(weight)).alias("rows"),
        F.min(id_column).alias("first_row"),
        *[F.min(z).alias(f"lo_{z}") for z in Z_COLUMNS],
        *[F.max(z).alias(f"hi_{z}") for z in Z_COLUMNS],
        *[F.min_by(z, id_column).alias(f"rep_{z}") for z in Z_COLUMNS],
    )


@dataclass(frozen=True)
class Grid:
    """Cells for one radius, numbered by one BIGINT each.

    The batch and the two flags are part of every number, so only the continuous features are
    cut. ``per_tile`` fine cells make one tile, at least ``radius`` wide: whatever lies within
    the radius of a point is in its own or a directly adjacent tile. Tile numbers leave room
    for a neighbour on both ends of each axis, so a neighbour is a fixed number away.
    """

    radius: float
    side: float
    per_tile: int
    axes: tuple[str, ...]
    first: tuple[int, ...]  # index of the lowest fine cell per axis
    cells: tuple[int, ...]  # fine cells per axis
    flips: tuple[int, ...]

    @staticmethod
    def fits(scale: Scale, radius: float) -> bool:
        try:
            Grid.fit(scale, radius)
        except ValueError:
            return False
        return True

    @staticmethod
    def fit(scale: Scale, radius: float, batches: int = 1) -> "Grid":
        used = [c for c in FEATURES if c not in FLAG_FEATURES and scale.high[c] > scale.low[c]]
        dims = max(1, len(used))
        side = radius / math.sqrt(dims) * (1 + MARGIN)
        first = tuple(math.floor(scale.low[c] / side) for c in used)
        cells = tuple(math.floor(scale.high[c] / side) - f + 1 for c, f in zip(used, first))
        if math.prod(n + 3 for n in cells) * 4 * batches >= 2 ** 62:
            raise ValueError(f"radius {radius} is too small for the spread of the features")
        return Grid(radius, side, math.ceil(math.sqrt(dims)), tuple(f"z_{c}" for c in used),
                    first, cells, flag_flips(scale, radius))

    def _number(self, digits: list[Column], sizes: list[int]) -> Column:
        number = F.col("batch_id")
        for digit, size in zip(digits, sizes):
            number = number * size + digit
        return number * 4 + F.col("flags")

    def _indexes(self) -> list[Column]:
        return [F.floor(F.col(z) / F.lit(self.side)) - f for z, f in zip(self.axes, self.first)]

    @property
    def _tiles(self) -> list[int]:
        return [(n - 1) // self.per_tile + 3 for n in self.cells]

    def cell(self) -> Column:
        return self._number(self._indexes(), list(self.cells))

    def batch_of(self, cell: str) -> Column:
        return whole(F.col(cell), 4 * math.prod(self.cells))

    def index_of(self, cell: str, axis: int) -> Column:
        """Index of a cell on one axis, counted from the lowest cell."""
        below = 4 * math.prod(self.cells[axis + 1:])
        return F.pmod(whole(F.col(cell), below), F.lit(self.cells[axis]))

    def tile(self) -> Column:
        digits = [F.floor(i / F.lit(self.per_tile)) + 1 for i in self._indexes()]
        return self._number(digits, self._tiles)

    def near_tiles(self, df: DataFrame, half: bool = False) -> DataFrame:
        """One copy of each row for its tile and every adjacent one, in column ``tile``.

        With ``half``, for a join of a table with itself: of two tiles that are neighbours only one is named, and
        ``home`` marks the copies for the row's own tile, in which pairs still come up both ways.
        """
        steps = [0]
        for size in self._tiles:
            steps = [s * size + o for s in steps for o in (-1, 0, 1)]
        if half:
            steps = [s for s in steps if s >= 0]
        around = F.explode(F.array(*[F.lit(s * 4).cast("long") for s in steps]))
        moved = df.withColumn("_s", around).withColumn("tile", F.col("tile") + F.col("_s"))
        moved = (moved.withColumn("home", F.col("_s") == 0) if half else moved).drop("_s")
        if self.flips == (0,):
            return moved
        flags = F.pmod(F.col("tile"), F.lit(4))
        flip = F.explode(F.array(*[F.lit(m).cast("long") for m in self.flips]))
        return moved.withColumn("_m", flip).withColumn(
            "tile", F.col("tile") - flags + flags.bitwiseXOR(F.col("_m"))).drop("_m")


def flag_flips(scale: Scale, radius: float) -> tuple[int, ...]:
    """Flag combinations (as bit masks) that can differ between two rows within ``radius``.

    Two rows that differ in a flag lie at least ``1/std`` apart, so for a small radius the
    flags are plain equality keys.
    """
    limit = radius * radius * (1 + MARGIN)
    masks = []
    for bits in product((0, 1), repeat=len(FLAG_FEATURES)):
        apart = sum(scale.flag_gap(c) ** 2 for c, on in zip(FLAG_FEATURES, bits) if on)
        if apart <= limit:
            masks.append(sum(on << i for i, on in enumerate(bits)))
    return tuple(masks)


def flags_column() -> Column:
    """The two flags as one number, bit ``i`` for the ``i``-th flag feature."""
    return reduce(add, [F.col(c).cast("int") * (1 << i) for i, c in enumerate(FLAG_FEATURES)])


def prepare_points(scaled: DataFrame, grid: Grid) -> DataFrame:
    """Rows with flags, fine cell and tile; ``batch_id`` must be there."""
    return (
        scaled.withColumn("flags", flags_column())
        .withColumn("cell", grid.cell())
        .withColumn("tile", grid.tile())
        .select("row_id", "batch_id", "cell", "tile", *Z_COLUMNS)
    )
