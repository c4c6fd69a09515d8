"""Mixing sources to target weights with a low-discrepancy schedule.

Each source is a shuffled stream of its documents, cut into blocks of equally many words. The schedule's
slots are golden-ratio points mapped through the cumulative weights, so every stretch of it holds
the sources in their proportions; a slot takes its source's next block, and a source that ends
starts again. The stream of a source stops at its target, in the middle of a block if need be.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewsift.session import materialize

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: 2**64 divided by the golden ratio, odd: multiples of it modulo 2**64 are the schedule's points.
GOLDEN = 0x9E3779B97F4A7C15
WORD = r"[^\x20\x09-\x0D]+"
#: A mix names its sources and weights, so their table is small; more than this many is an error.
MAX_SOURCES = 100_000
#: Rows of one running sum, on average: a task sorts about so many documents of a source.
STRETCH = 4_000


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[float], repeat: float = MAX_REPEAT) -> list[float]:
    """Share the sum of ``sizes`` by weight; no share above ``repeat`` sizes, the excess goes to the others."""
    total, full = float(sum(sizes)), [False] * len(sizes)
    while True:
        left = total - sum(repeat * s for s, f in zip(sizes, full) if f)
        open_weight = sum(w for w, f in zip(weights, full) if not f)
        target = [float(repeat * s) if f else w * left / open_weight for s, w, f in zip(sizes, weights, full)]
        over = [not f and t > repeat * s for s, f, t in zip(sizes, full, target)]
        if not any(over):
            return target
        full = [f or o for f, o in zip(full, over)]


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, repeat: float = MAX_REPEAT) -> DataFrame:
    """``(number, source, source_size, target)`` of ``sized(source, size)``.

    Sources are numbered by code point, null last, and take the weights in turn.
    """
    spark = sized.sparkSession
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = sums.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    share = water_fill([r.source_size for r in rows], [weights[i % len(weights)] for i in range(len(rows))], repeat)
    return spark.createDataFrame(
        [(i, r.source, r.source_size, t) for i, (r, t) in enumerate(zip(rows, share))],
        "number int, source string, source_size long, target double")


def place(sized: DataFrame) -> DataFrame:
    """Add ``number``'s stream order: ``start``, the words of the source before this row.

    The order is by a digest of the id, so it looks shuffled and every run has the same. Rows are summed
    in stretches of about ``STRETCH``, a source's stretches are summed after that.
    """
    rows = sized.count()
    parts = max(1, rows // STRETCH)
    digest = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    placed = sized.withColumn("_d", digest).withColumn(
        "_part", F.floor(F.conv(F.substring("_d", 1, 8), 16, 10).cast("long") * parts / 2**32))
    order = Window.partitionBy("number", "_part").orderBy("_d", "size")
    inside = placed.withColumn("_at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    inside = materialize(inside.drop("_d"), "stream")
    sums = inside.groupBy("number", "_part").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("number").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        sums.select("number", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), "stretches")
    return (
        inside.join(starts, ["number", "_part"])
        .withColumn("start", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
    )


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """``(slot, number, rank, in_pass, at_block, cut)``: which block each slot takes.

    A source needs as many slots as its target has blocks. Points decide who takes a slot; a source's slots
    beyond its need are skipped, missing ones (the points' discrepancy, a few) follow at the end.
    ``cut`` is where the slot's pass over the source stops, in words from its start.
    """
    spark = sources.sparkSession
    need = sources.where("source_size > 0 AND target > 0").withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
    per_pass = F.ceil(F.col("source_size") / F.lit(block))
    passes = F.expr("quota div source_size")
    need = need.withColumn("per_pass", per_pass).withColumn(
        "slots", passes * F.col("per_pass") + F.ceil((F.col("quota") - passes * F.col("source_size")) / F.lit(block)))
    rows = need.select("number", "slots").where("slots > 0").orderBy("number").collect()  # at most MAX_SOURCES
    if not rows:
        rows = []
    numbers = np.array([r.number for r in rows], np.int32)
    bounds = np.cumsum([r.slots for r in rows]).astype(np.float64)
    total = int(bounds[-1]) if rows else 0

    def points(batches):
        for b in batches:
            i = b.column(0).to_numpy().astype(np.uint64)
            u = ((i + np.uint64(1)) * np.uint64(GOLDEN)) / 2.0**64
            at = np.minimum(np.searchsorted(bounds, u * total, side="right"), len(numbers) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(numbers[at], pa.int32())], ["slot", "number"])

    parts = max(1, total // 1_000_000)
    chosen = spark.range(total).repartition(parts) if total > 1_000_000 else spark.range(0, total, 1, 1)
    picked = chosen.mapInArrow(points, "slot long, number int")
    # rank within the source: inside stretches of slots, then over the stretches
    picked = picked.withColumn("_part", F.expr(f"slot div {STRETCH}"))
    counts = picked.groupBy("number", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("number").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("number", "_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    starts = materialize(starts, "slot-counts")
    ranked = picked.withColumn(
        "_at", F.row_number().over(Window.partitionBy("number", "_part").orderBy("slot")) - 1).join(
        starts.drop("_n"), ["number", "_part"]).select("slot", "number", (F.col("_start") + F.col("_at")).alias("rank"))
    got = starts.groupBy("number").agg(F.sum("_n").alias("_got"))
    missing = (
        need.join(got, "number", "left").withColumn("_got", F.coalesce("_got", F.lit(0))).where("_got < slots")
        .select("number", F.explode(F.sequence(F.col("_got"), F.col("slots") - 1)).alias("rank"))
        .select((F.lit(total) + F.col("rank")).alias("slot"), "number", "rank")
    )
    all_slots = ranked.unionByName(missing).join(F.broadcast(need), "number").where("rank < slots")  # MAX_SOURCES
    in_pass = F.expr("rank div per_pass")
    return all_slots.select(
        "slot", "number", "rank", in_pass.alias("in_pass"), (F.col("rank") % F.col("per_pass")).alias("at_block"),
        F.least(F.col("source_size"), F.col("quota") - in_pass * F.col("source_size")).alias("cut"))


def mix(placed: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """``(slot, row, from_word, words)``: the words of each row that a slot takes, from its ``from_word`` on.

    ``placed`` has ``row, number, start, size``; a row is cut into its pieces of blocks of ``block`` words.
    """
    last = F.expr(f"(start + size - 1) div {block}")
    pieces = placed.where("size > 0").select("row", "number", "start", "size", F.explode(
        F.sequence(F.expr(f"start div {block}"), last)).alias("at_block"))
    begin = F.greatest(F.col("start"), F.col("at_block") * block)
    stop = F.least(F.col("start") + F.col("size"), (F.col("at_block") + 1) * block, F.col("cut"))
    return (
        pieces.join(slots, ["number", "at_block"]).withColumn("words", stop - begin).where("words > 0")
        .select("slot", "row", (begin - F.col("start")).alias("from_word"), "words")
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[float] = WEIGHTS, repeat: float = MAX_REPEAT, block: int = 512,
                carry: Sequence[str] = ()) -> DataFrame:
    """``(id, source, size, source_size, target, taken)`` for every row of ``docs``, with its ``carry`` columns.

    Texts that are null or have no words take part with size 0 and are never taken. A null source is a source,
    the last one; null and repeated ids are rows like any other. An empty table gives no rows. The words
    taken of a source are its target, rounded; the words of one row differ by at most one pass over it.
    """
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), *carry)
    sized = materialize(sized, "sizes")
    sources = targets(sized, weights, repeat)
    small = F.broadcast(sources.select("number", F.col("source").alias("_s"), "source_size", "target"))
    numbered = sized.join(small, sized["source"].eqNullSafe(F.col("_s"))).drop("_s", "source_size", "target")
    placed = place(numbered)
    placed = materialize(placed.withColumn("row", F.concat_ws(
        ":", "number", "start", F.col("id").cast("string"))), "placed")  # unique where size > 0
    taken = mix(placed, schedule(sources, block), block).groupBy("row").agg(F.sum("words").alias("taken"))
    out = placed.join(taken, "row", "left").join(small, "number")
    return out.select("id", "source", "size", "source_size", "target",
                      F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"), *carry)
