"""SimHash near-duplicate classes by deletion-variant signatures.

A fingerprint is cut into two 32-bit segments. If two fingerprints differ in at most two bits, one
of their segments differs in at most one, so they share a variant of that segment in which one bit
is a wildcard. Variants are the equality key of the candidate search; every candidate is verified.

Fingerprints, not documents, are compared: copies collapse first. A variant shared by more than
``DENSE`` fingerprints is not expanded into pairs. Its members are indexed again by variants of the
whole fingerprint with two wildcards, taken among the bits that vary in their buckets; such a key
is shared by four fingerprints at most, so the work stays in proportion to the members and no link
is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsift.llm.common import bounded, per_value
from reviewsift.operators.components import connected_components
from reviewsift.session import materialize

SEED = 42
#: Hashes whose bits are counted at once, so a text of any length needs bounded memory.
SLAB = 1 << 16
#: Buckets above this size are searched by two-wildcard variants instead of by pairs. Both ways find
#: the same links; at 64 variants a fingerprint, pairs cost more from about here.
DENSE = 128
BITS = 2


def _simhash(text: bytes | None, width: int) -> int:
    words = (text or b"").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    first, last = starts[:n].tolist(), ends[len(words) - n:].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, SLAB):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(first[at:at + SLAB], last[at:at + SLAB])], ">u8")
        counts += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    """64-bit SimHash of ``width``-word shingles (repeats count) as a long; null and wordless texts: 0."""

    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return per_value(batches, pa.int64(), lambda texts: [_simhash(t, width) for t in texts])

    return simhash(text.cast("binary"))


def variants(prints: DataFrame) -> DataFrame:
    """``(key, fp)``: the 2 x 32 one-wildcard segment variants of each fingerprint."""
    i = F.col("_i")
    segment = F.when(i < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    wild = F.expr("shiftleft(1L, _i % 32)")
    key = segment.bitwiseAND(F.bitwise_not(wild)).bitwiseOR(F.expr("shiftleft(cast(_i as bigint), 32)"))
    return prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_i")).select(key.alias("key"), "fp")


def _close(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= BITS


def _dense_links(members: DataFrame) -> DataFrame:
    """Links between members ``(key, fp)`` of large buckets."""
    masks = materialize(
        members.groupBy("key").agg(F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("mask")), "masks")
    mine = members.join(masks, "key").groupBy("fp").agg(F.bit_or("mask").alias("mask"))
    bits = F.expr("filter(sequence(0, 63), b -> (shiftrightunsigned(mask, b) & 1L) = 1L)")
    wild = (
        mine.withColumn("_bits", bits).select("fp", "_bits", F.explode("_bits").alias("i"))
        .select("fp", "i", F.explode(F.expr("filter(_bits, b -> b >= i)")).alias("j"))
        .withColumn("_key", F.expr("fp & ~shiftleft(1L, i) & ~shiftleft(1L, j)"))
    )
    groups = (
        wild.groupBy("i", "j", "_key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
        .where("n > 1")
    )
    # at most four fingerprints agree outside two bits; the two between least and greatest are rare
    pairs = groups.select("u", "v")
    more = groups.where("n > 2").select("i", "j", "_key", "u")
    rest = wild.join(more, ["i", "j", "_key"]).where(F.col("fp") != F.col("u")).select("u", F.col("fp").alias("v"))
    return pairs.unionByName(rest).where(_close("u", "v"))


def links(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """``(u, v)``: pairs of distinct fingerprints ``fp`` at two bits or fewer; enough of them that two
    fingerprints are connected by these exactly if they are connected by all. ``prints`` is a stored table.
    """
    keys = materialize(
        variants(prints).groupBy("key")
        .agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"), "shared")
    pairs = keys.where("n = 2 and u <> v").select("u", "v").where(_close("u", "v"))
    larger = bounded(keys.where("n > 2").select("key", "n"))
    members = materialize(variants(prints).join(larger, "key"), "members")
    few = members.where(F.col("n") <= dense)
    among = few.select("key", F.col("fp").alias("u")).join(
        few.select("key", F.col("fp").alias("v")), "key").where((F.col("u") < F.col("v")) & _close("u", "v"))
    many = _dense_links(members.where(F.col("n") > dense))
    return pairs.unionByName(among.select("u", "v")).unionByName(many).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                    dense: int = DENSE) -> DataFrame:
    """``(id, fp, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest id among the rows reachable over links of two bits or fewer.
    Null, empty and wordless texts have fingerprint 0 and link like any other. Rows with a null id
    take part; they name a component only where no row has an id (then null). Equal ids are one
    document per text. An empty table gives an empty result. Other columns are not read.
    """
    prints = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"))
        .select("id", fingerprint(F.col("_t"), width).alias("fp")), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    member = materialize(connected_components(links(classes.select("fp"), dense)), "components")
    named = member.join(classes, member["node"] == classes["fp"])
    groups = named.groupBy("component").agg(F.min("least").alias("least"))
    linked = member.join(groups, "component").select(F.col("node").alias("fp"), F.col("least").alias("group_id"))
    labels = materialize(
        classes.join(linked, "fp", "left")
        .select("fp", F.coalesce("group_id", "least").alias("component_id")), "labels")
    return prints.join(labels, "fp").select("id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
