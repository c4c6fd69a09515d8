"""Candidate pairs of similar unit vectors inside groups, by prefix keys that adapt to a group's size.

The terms of a vector are in one order, rarest first. Two vectors with a cosine above the threshold share a term
among the first few of each, so these are the keys of the search. Where a key of a group has many members, they
are not paired: what two of them share goes on, so they are keyed again by a second shared term, then a third.
A vector can follow a pair's shared terms only as far as the terms it skips leave the threshold in reach (the length
bound), which keeps the further keys few; a pair that shares no more terms than the key must reach the
threshold by these. Keys with few members are joined with themselves under a bound on what may follow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewsift.operators.ordering import hot_keys, join_hot, spread_join
from reviewsift.session import materialize

#: Members of a key that are compared with each other, and shared terms in a key at most. Neither decides which
#: pairs are found.
MEMBERS, TERMS = 16, 4
SLACK = 1e-9


def ordered_terms(vectors: DataFrame) -> DataFrame:
    """``vectors(text_id, df, term, weight)`` in their order: ``pos``, ``here`` (squared length from this term on) and
    ``rest`` (length behind it)."""
    order = Window.partitionBy("text_id").orderBy("df", "term")
    upto = F.sum(F.col("weight") * F.col("weight")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.greatest(1 - upto, F.lit(0.0))
    return vectors.select(
        "text_id", "term", "weight", F.row_number().over(order).alias("pos"),
        (behind + F.col("weight") * F.col("weight")).alias("here"), F.sqrt(behind).alias("rest"))


def _weights() -> list[str]:
    return [f"w{i}" for i in range(1, TERMS + 1)]


def _first_keys(members: DataFrame, terms: DataFrame, threshold: float) -> DataFrame:
    prefixes = materialize(terms.where(F.col("here") >= threshold ** 2 - SLACK), "prefixes")
    weights = materialize(members.groupBy("text_id").agg(F.count("*").alias("_n")), "text_groups")
    joined = spread_join(members, prefixes, ["text_id"], hot_keys(weights, ["text_id"], "_n"), "group_id")
    zero = [F.lit(0.0).alias(w) for w in _weights()[1:]]
    return joined.select("group_id", "text_id", F.xxhash64("term").alias("key"), "pos", "rest",
                         (F.col("weight") * F.col("weight")).alias("used"), F.col("weight").alias("w1"), *zero)


def _further_keys(rows: DataFrame, terms: DataFrame, level: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows of large keys by one more shared term, and by no more."""
    limit = threshold ** 2 - SLACK
    columns = ["group_id", "text_id", "key", "pos", "rest", "used", *_weights()]
    ended = rows.where(F.col("used") >= limit).withColumns(
        {"key": F.xxhash64("key", F.lit("")), "rest": F.lit(0.0)}).select(*columns)
    more = terms.select("text_id", "term", "weight", F.col("pos").alias("_pos"), "here", F.col("rest").alias("_rest"))
    next_one = rows.join(more, "text_id").where(
        (F.col("_pos") > F.col("pos")) & (F.col("used") + F.col("here") >= limit))
    next_one = next_one.withColumns({
        "key": F.xxhash64("key", "term"), "pos": F.col("_pos"), "rest": F.col("_rest"),
        "used": F.col("used") + F.col("weight") * F.col("weight"), f"w{level + 1}": F.col("weight")}).select(*columns)
    return next_one, ended


def candidate_pairs(members: DataFrame, terms: DataFrame, threshold: float, most: int = MEMBERS) -> DataFrame:
    """``(group_id, text_a, text_b)``: pairs of one group that may exceed the threshold, all that do among them.

    ``members(group_id, text_id)`` and ``terms`` (see ``ordered_terms``) are stored tables. ``most`` is the number of
    members from which a key is refined.
    """
    keyed, done = materialize(_first_keys(members, terms, threshold), "keyed"), []
    for level in range(1, TERMS + 1):
        sizes = keyed.groupBy("group_id", "key").agg(F.count("*").alias("n"))
        large = materialize(sizes.where(F.col("n") > most), "large_keys") if level < TERMS else None
        if large is None or large.isEmpty():
            done.append(keyed)
            break
        marked = materialize(join_hot(keyed, large, ["group_id", "key"], "n", "text_id"), "marked")
        done.append(marked.where("n is null").drop("n"))
        further, ended = _further_keys(marked.where("n is not null").drop("n"), terms, level, threshold)
        done.append(ended)
        keyed = materialize(further, "keyed")
    rows = materialize(reduce(DataFrame.unionByName, done), "settled")
    sizes = materialize(rows.groupBy("group_id", "key").agg(F.count("*").alias("n")).where("n > 1"), "key_sizes")
    # a key of n members means n * n comparisons: spread from a far smaller size on
    hot = hot_keys(sizes, ["group_id", "key"], "n", floor=20_000)
    side = lambda s: rows.select("group_id", "key", *[F.col(c).alias(f"{s}_{c}") for c in ("text_id", "rest", *_weights())])
    products = [F.col(f"a_{w}") * F.col(f"b_{w}") for w in _weights()]
    bound = reduce(Column.__add__, products) + F.col("a_rest") * F.col("b_rest")
    found = spread_join(side("a"), side("b"), ["group_id", "key"], hot, "a_text_id").where(
        (F.col("a_text_id") < F.col("b_text_id")) & (bound >= threshold - SLACK))
    return found.select("group_id", F.col("a_text_id").alias("text_a"), F.col("b_text_id").alias("text_b")).distinct()
