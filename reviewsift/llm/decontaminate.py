"""Benchmark decontamination by a prefix-filtered join, with exact window verification.

Windows are ``width`` consecutive words of a benchmark item (an item with fewer words is one window). Each
window is a set of shingles; ordered by rarity in the corpus, the first shingle is a necessary prefix:
a document that holds the window holds its rarest shingle. Only those shingles are looked up in the
documents. A hit fixes where the window would have to start (positional bound) and end (length
bound); the document's words there are joined with the windows' words, which verifies exactly.

The benchmark's tables are stored, so Spark knows their size: it broadcasts them while they are under its
threshold and shuffles (splitting hot shingles) beyond.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsift.llm.common import EMPTY_SHA256, ascii_lower, bounded, row_key, same
from reviewsift.session import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH, SHINGLE = 10, 3


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def shingle_rows(df: DataFrame, array: str, size: int, keep: list[str], outer: bool = False) -> DataFrame:
    """``keep..., pos, size, shingle`` of an array of words: a hash of the ``size`` words from ``pos`` on.

    The last positions have shorter shingles, which no window has; a hash can only name too many candidates.
    With ``outer`` an empty array has one row, its ``pos`` null.
    """
    parts = ", ".join(f"slice({array}, {k + 1}, size({array}))" if k else array for k in range(size))
    names = [array, *map(str, range(1, size))]
    explode = F.posexplode_outer if outer else F.posexplode
    return (
        df.select(*keep, explode(F.expr(f"arrays_zip({parts})")).alias("pos", "_s"))
        .select(*keep, "pos", F.lit(size).alias("size"), F.xxhash64(*[F.col("_s").getField(n) for n in names]).alias("shingle"))
    )


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """``(window, len, item)``: the distinct windows of each item; items without words have none."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    start = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    return (
        items.where(F.size("w") > 0).select("item", "w", F.explode(start).alias("at"))
        .select("item", F.slice("w", F.col("at") + 1, F.lit(width)).alias("ws"))
        .select("item", F.array_join("ws", " ").alias("window"), F.size("ws").alias("len")).distinct()
    )


def contaminated_windows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         item_col: str = "item_id", item_text: str = "text", width: int = WIDTH,
                         shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occurrences of benchmark windows, ``(id, key, start, len, window)``; ``(window, len, item)``; and ``(id, key,
    n_words)`` of every row of ``docs``.

    ``start`` counts words from 0. ``key`` tells texts of equal ids apart. Null texts and texts or
    items without words have no occurrence; equal rows give one.
    """
    owners = materialize(benchmark_windows(benchmark, item_col, item_text, width), "windows")
    windows = owners.select("window", "len").distinct()
    sizes = [r[0] for r in windows.select(F.least("len", F.lit(shingle)).alias("s")).distinct().orderBy("s").collect()]
    sizes = sizes[::-1] or [shingle]  # at most ``shingle``
    split = windows.withColumn("ws", F.split("window", " "))
    parts = _union(
        shingle_rows(split.where(F.least("len", F.lit(shingle)) == s), "ws", s, ["window", "len"])
        .where(F.col("pos") <= F.col("len") - s) for s in sizes)
    parts = materialize(parts, "window-shingles")

    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"))
    tokens = text.select("id", row_key(F.col("_t")).alias("key"), words(F.col("_t")).alias("w")).withColumn(
        "n", F.size("w"))
    known = bounded(materialize(parts.select("size", "shingle").distinct(), "shingles"))
    rarity = materialize(
        _union(shingle_rows(tokens, "w", s, []) for s in sizes).join(known, ["size", "shingle"])
        .groupBy("size", "shingle").agg(F.count("*").alias("freq")), "rarity")
    # a window with a shingle that no document has cannot occur
    ordered = parts.join(rarity, ["size", "shingle"], "left").groupBy("window", "len").agg(
        F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "size", "shingle", "pos")).alias("p"))
    prefix = materialize(
        ordered.where("p.freq > 0").groupBy("p.size", "p.shingle")
        .agg(F.collect_set(F.struct(F.col("p.pos").alias("off"), "len")).alias("ends")),  # width squared at most
        "prefix")

    # the first row of every document stays, with or without a hit
    probe = None
    for i, s in enumerate(sizes):
        rows = shingle_rows(tokens, "w", s, ["id", "key", "n"], outer=i == 0)
        found = rows.join(bounded(prefix), ["size", "shingle"], "inner" if i else "left").withColumn("size", F.lit(s))
        found = found if i else found.where("ends IS NOT NULL OR pos IS NULL OR pos = 0")
        found = found.select("id", "key", "n", "pos", "ends", F.lit(i == 0).alias("first_size"))
        probe = found if probe is None else probe.unionByName(found)
    probe = materialize(probe, "probe")
    rows = probe.where("first_size AND (pos IS NULL OR pos = 0)").select("id", "key", F.col("n").cast("long").alias("n_words"))
    spots = (
        probe.where("ends IS NOT NULL").select("id", "key", "n", "pos", F.explode("ends").alias("e"))
        .select("id", "key", "n", (F.col("pos") - F.col("e.off")).alias("start"), F.col("e.len").alias("len"))
        .where("start >= 0 AND start + len <= n").distinct()
        .groupBy("id", "key").agg(F.collect_list(F.struct("start", "len")).alias("spots"))  # at most the words
    )
    spots = materialize(spots, "spots")
    held, few = text.withColumn("key", row_key(F.col("_t"))), bounded(spots)
    found = (
        held.join(few, same(held, few, "id", "key"))
        .select(few["id"], few["key"], words(F.col("_t")).alias("w"), "spots")
        .select("id", "key", F.explode(F.expr(
            "transform(spots, s -> struct(s.start AS start, s.len AS len,"
            " array_join(slice(w, s.start + 1, s.len), ' ') AS window))")).alias("s"))
        .select("id", "key", "s.*")
    )
    hits = materialize(found.join(windows, ["window", "len"], "left_semi").distinct(), "hits")
    return hits, owners, rows


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", width: int = WIDTH,
                  shingle: int = SHINGLE) -> DataFrame:
    """``(id, key, n_words, n_hit, items, contaminated)`` for every row of ``docs``.

    ``n_hit`` counts words inside any occurrence of a window, ``items`` is the sorted array of the ids
    (as strings) of the items with one. Null texts have no words; null item ids count as no item
    though their windows hit. Equal rows get equal results, ids may be null or repeated.
    """
    hits, owners, rows = contaminated_windows(docs, benchmark, id_col, text_col, item_col, item_text, width, shingle)
    cover = hits.groupBy("id", "key").agg(F.size(F.array_distinct(F.flatten(F.transform(
        F.collect_set(F.struct("start", "len")),
        lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))).cast("long").alias("n_hit"))
    named = (
        hits.select("id", "key", "window", "len").distinct().join(owners, ["window", "len"])
        .select("id", "key", "item").distinct()
        .groupBy("id", "key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    found = cover.join(named, same(cover, named, "id", "key"), "left").select(
        cover["id"].alias("_id"), cover["key"].alias("_key"), "n_hit", "items")
    found = materialize(found, "contaminated")
    none = F.array().cast("array<string>")
    return rows.join(found, rows["id"].eqNullSafe(found["_id"]) & (rows["key"] == found["_key"]), "left").select(
        "id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def items_digest(items: Column) -> Column:
    return F.when(F.size(items) == 0, F.lit(EMPTY_SHA256)).otherwise(F.sha2(F.array_join(items, ","), 256))
