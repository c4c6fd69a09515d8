"""Dense positions without a single-task window, and joins that split hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewsift.session import materialize

_LOCAL_BITS = 33  # layout of monotonically_increasing_id: partition << 33 | row in partition


def with_position(df: DataFrame, order: Sequence[Column], within: Sequence[str] = (),
                  position: str = "pos") -> DataFrame:
    """Add the 0-based position of each row in ``order`` (inside each ``within`` group).

    ``order`` must be total (end it with a unique id). Rows are range-partitioned on the
    whole order, so a tie or a hot group spreads over several tasks; each task numbers its
    own slice and the per-slice counts turn local numbers into positions.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc() for c in within] + list(order)
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = materialize(
        df.repartitionByRange(slices, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id()),
        "position",
    ).withColumn("_slice", F.shiftright("_mid", _LOCAL_BITS))
    # one row per slice, at most shuffle.partitions rows
    starts = (
        numbered.groupBy("_slice").agg(F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(
            Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("_slice", "_start")
    )
    local = F.col("_mid") - F.shiftleft("_slice", _LOCAL_BITS)
    placed = numbered.join(F.broadcast(starts), "_slice").withColumn(position, F.col("_start") + local)
    placed = placed.drop("_slice", "_start", "_mid")
    if within:
        first = small(materialize(placed.groupBy(*within).agg(F.min(position).alias("_first")), "firsts"))
        placed = (
            placed.join(first, list(within))
            .withColumn(position, F.col(position) - F.col("_first"))
            .drop("_first")
        )
    return placed


BROADCAST_ROWS = 50_000  # rows of a stored table of boxes, limits or sums that may be broadcast


def whole(number: Column, divisor: int) -> Column:
    """Integer division of non-negative BIGINTs, exact for all of them (no detour through DOUBLE)."""
    return F.call_function("div", number, F.lit(divisor).cast("long"))


def small(stored: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``stored`` to be broadcast if it has at most ``rows`` rows (counted); the join shuffles it otherwise."""
    return F.broadcast(stored) if stored.count() <= rows else stored


HOT_ROWS = 1_000_000  # a key below this many rows is never worth spreading
HOT_SHARE = 1000  # a hot key holds more than 1/HOT_SHARE of all rows


def hot_keys(counts: DataFrame, key: Sequence[str], weight: str,
             floor: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than ``1/HOT_SHARE`` of the total weight (so fewer than HOT_SHARE keys).

    ``counts`` is a stored table; None where no key is hot.
    """
    total, largest = counts.agg(F.sum(weight), F.max(weight)).first()
    limit = max(floor, (total or 0) // HOT_SHARE)
    if (largest or 0) <= limit:
        return None
    return counts.where(F.col(weight) > limit).select(*key)


def join_hot(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str,
             spread_by: str, how: str = "left", salts: int = 64, floor: int = HOT_ROWS) -> DataFrame:
    """Equi-join where a key may hold a large part of ``left``.

    ``right`` is a stored table with one row per key and the key's row count in ``weight``.
    Rows of hot keys are spread over ``salts`` buckets and only those rows of ``right`` are
    repeated. Without a hot key this is a plain join.
    """
    return spread_join(left, right, keys, hot_keys(right, keys, weight, floor), spread_by, how, salts)


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: DataFrame | None,
                spread_by: str, how: str = "inner", salts: int = 64) -> DataFrame:
    """Equi-join with the rows of ``hot`` keys spread over ``salts`` buckets of ``left``."""
    keys = list(keys)
    if hot is None:
        return left.join(right, keys, how)
    hot = hot.withColumn("_hot", F.lit(True))
    salted_left = (
        left.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(salts)))
                    .otherwise(F.lit(0)).cast("int"))
        .drop("_hot")
    )
    salted_right = (
        right.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.when(
            F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        .drop("_hot")
    )
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def drop_members(df: DataFrame, members: DataFrame, key: str, weight: str,
                 floor: int = HOT_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``members`` (a stored table with row counts).

    Hot members go first, through a broadcast of fewer than HOT_SHARE keys, so the shuffled
    anti-join never meets a hot key.
    """
    hot = hot_keys(members, [key], weight, floor)
    if hot is not None:
        df = df.join(F.broadcast(hot), key, "left_anti")
    return df.join(members.select(key), key, "left_anti")


BIT_ROWS = 32768  # bits of one row of a bitmap
BIT_MAPS = 16_384  # rows of a bitmap (64 MB) that may be broadcast


def _bitmap(members: DataFrame, key: str, bits: int, seed: int | None = None) -> tuple[DataFrame, int]:
    """Hashes of the keys, ``bits`` places for each, as a stored bitmap of ``slots`` rows."""
    slots = 1 + members.count() * bits // BIT_ROWS
    slot, bit = _place(key, slots, seed)
    return materialize(
        members.select(slot.alias("_slot"), bit.alias("_bit")).groupBy("_slot").agg(F.bitmap_construct_agg("_bit").alias("_map")),
        "bitmap"), slots


def _place(key: str, slots: int, seed: int | None) -> tuple[Column, Column]:
    hashed = F.xxhash64(key) if seed is None else F.xxhash64(key, F.lit(seed))
    place = F.pmod(hashed, F.lit(slots * BIT_ROWS))
    return whole(place, BIT_ROWS), F.pmod(place, F.lit(BIT_ROWS))


def _is_set() -> Column:
    byte = F.conv(F.hex(F.substring("_map", whole(F.col("_bit"), 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod("_bit", F.lit(8)).cast("int"))) != 0


def likely_members(df: DataFrame, key: str, members: DataFrame, bits: int = 16) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``members`` (a stored table), and about one in ``bits`` of the others.

    Hashes of the keys are kept as a bitmap, which is broadcast, so wide rows that a following inner join drops are not
    shuffled for it. A bitmap beyond the limit is not made.
    """
    if 1 + members.count() * bits // BIT_ROWS > BIT_MAPS:
        return df
    maps, slots = _bitmap(members, key, bits)
    slot, bit = _place(key, slots, None)
    return df.withColumns({"_slot": slot, "_bit": bit}).join(F.broadcast(maps), "_slot").where(_is_set()).drop("_slot", "_bit", "_map")


def without_ids(df: DataFrame, key: str, ids: DataFrame, every: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``ids``; ``every`` holds all keys of ``df`` (both are stored tables).

    The wide rows are not shuffled. Up to ``rows`` ids are broadcast. More are a bitmap of hashes; the other keys that it
    names by chance are known from ``every`` and are a second one, the ids that this one names a third, each some
    sixteen times smaller, until the last are few and are broadcast as they are, so the result is exact. Ids beyond
    the limit of a bitmap with four places each are joined by a shuffle. A null key stays.
    """
    rows, few = BROADCAST_ROWS if rows is None else rows, ids.count()
    if few <= rows:
        return df.join(F.broadcast(ids), key, "left_anti")
    whole_df, columns, levels = df, df.columns, 0
    inside = materialize(ids.select(key).where(F.col(key).isNotNull()).distinct(), "ids")
    outside = materialize(every.select(key).distinct().join(inside, key, "left_anti"), "other_ids")
    while (n := inside.count()) > rows:
        bits = min(16, (BIT_MAPS - 1) * BIT_ROWS // n)
        if bits < 4:
            return whole_df.join(ids, key, "left_anti")
        maps, slots = _bitmap(inside, key, bits, levels)
        named = lambda d, how: d.withColumns(dict(zip(("_slot", "_bit"), _place(key, slots, levels)))).join(
            F.broadcast(maps), "_slot", how)
        df = named(df, "left").withColumn(f"_in{levels}", F.coalesce(_is_set(), F.lit(False))).drop("_slot", "_bit", "_map")
        inside, outside, levels = materialize(named(outside, "inner").where(_is_set()).select(key), "named_ids"), inside, levels + 1
    df = df.join(F.broadcast(inside.withColumn(f"_in{levels}", F.lit(True))), key, "left")
    found = F.coalesce(f"_in{levels}", F.lit(False))
    for level in reversed(range(levels)):
        found = F.col(f"_in{level}") & ~found
    return df.where(F.col(key).isNull() | ~found).select(*columns)
