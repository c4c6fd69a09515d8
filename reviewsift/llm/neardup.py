"""Near-duplicate classes by shingle similarity: SimHash finds the closest, an exact prefix join the rest.

A text is the set of its shingles; texts with a Jaccard similarity of at least ``NUM / DEN`` are linked. Two fingerprints
of such texts may differ in 15 bits, far beyond the reach of deletion variants, so these find only the near copies at
two bits or fewer (``simhash.links``, here of shingles of this width); each is verified on the whole sets.

The rest is found exactly. In any order of all shingles, two linked sets share one of their first
``n - ceil(n * NUM / DEN) + 1``, at places behind which enough shingles follow in both, so these prefixes are the equality
keys of the search and every candidate is verified on the whole sets. Shingles that are common in a sample come
last in the order, the commonest at the very end; the sample decides how many candidates there are, never which pairs
are found.

Beside its prefix a text keeps an outline of its whole set: the parity of the shingles in each of about as many places as
there are shingles. Places in which two outlines differ hold a shingle that only one set has, so they bound the
similarity from above; pairs that it rules out never meet with their sets, and the others are verified.

Texts of the same words collapse first. The members of a key are compared with the one of them that shares most
shingles, and then only where they lie in different components; so a group of near copies makes no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsift.llm import simhash
from reviewsift.llm.common import BROADCAST_ROWS, bounded, per_value, row_key
from reviewsift.operators.components import connected_components
from reviewsift.operators.ordering import likely_members
from reviewsift.session import discard, materialize

SEED, WIDTH = 42, 5
#: Similarity from which two texts are near copies, as a fraction.
NUM, DEN = 4, 5
#: Every so manieth text is sampled for common shingles (all of fewer texts than ``SAMPLE``).
EVERY, SAMPLE = 16, 10_000
#: Bytes of sets that are broadcast at most; beyond, the same join shuffles.
HEAD_BYTES = 48 << 20
#: Places of an outline at least (a power of two).
PLACES = 64
#: Sampled texts from which a shingle is common, and how many of the commonest are put last.
COMMON, LISTED = 4, 1_000_000


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # of bytes: A-Z only, ASCII white space only


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of the shingles, repeats included; fewer words than ``width`` are one shingle."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    first, last = [0, *(ends[:n - 1] + 1).tolist()], ends[len(words) - n:].tolist() or [0]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(first, last)), np.uint64, n)


def _set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(_hashes(words, width).view(np.int64))


def _fingerprint(hashes: np.ndarray) -> int:
    """SimHash: a bit is one if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), simhash.SLAB):
        h = hashes[at:at + simhash.SLAB].astype(">u8")
        counts += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Sorted array of the shingles' hashes; null and wordless texts have one, of no words."""

    @F.arrow_udf("array<long>")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return per_value(batches, pa.list_(pa.int64()), lambda texts: [_set(_words(t), width) for t in texts])

    return sets(text.cast("binary"))


def _outline(found: np.ndarray) -> bytes:
    """Parity of the numbers of shingles in as many places as the power of two from their number on."""
    places = max(PLACES, 1 << (len(found) - 1).bit_length())
    return np.packbits(np.bincount(found & (places - 1), minlength=places) % 2 == 1).tobytes()


def _differing(a: bytes, b: bytes) -> int:
    """Places in which two outlines differ, the longer folded to the other's places: at most the shingles of one set only."""
    one, two = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    one, two = (one, two) if len(one) >= len(two) else (two, one)
    folded = np.bitwise_xor.reduce(one.reshape(-1, len(two)), axis=0)
    return int(np.bitwise_count(folded ^ two).sum())


def differing(a: Column, b: Column) -> Column:
    """``_differing`` of two columns of outlines."""

    @F.arrow_udf("long")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return per_value(batches, pa.int64(), lambda ends: [_differing(e["a"], e["b"]) for e in ends])

    return counts(F.struct(a.alias("a"), b.alias("b")))


_SKETCH = pa.struct([("d", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("prefix", pa.list_(pa.int64())),
                     ("outline", pa.binary())])


def _sketch(text: bytes | None, width: int, common: np.ndarray, rank: np.ndarray) -> dict:
    words = _words(text)
    hashes = _hashes(words, width)
    found = np.unique(hashes.view(np.int64))
    at = np.searchsorted(common, found)
    last = common[at] == found  # ``common`` ends with a guard
    size = len(found) - -(-len(found) * NUM // DEN) + 1
    behind = found[last][np.argsort(rank[at[last]], kind="stable")]
    return {"d": np.uint64(xxhash.xxh64_intdigest(b" ".join(words))).view(np.int64), "n": len(found), "fp": _fingerprint(hashes),
            "prefix": np.concatenate((found[~last], behind))[:size], "outline": _outline(found)}


def sketch(text: Column, width: int, common: np.ndarray, rank: np.ndarray) -> Column:
    """``d`` (hash of the words), ``n`` (size of the set), ``fp`` (SimHash), the prefix of the set, in order, and its
    ``outline``."""

    @F.arrow_udf("struct<d long, n int, fp long, prefix array<long>, outline binary>")
    def sketches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return per_value(batches, _SKETCH, lambda texts: [_sketch(t, width, common, rank) for t in texts])

    return sketches(text.cast("binary"))


def common_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles ``_t`` has in many texts of a sample, and the greatest number; their ranks,
    the commonest last."""
    every = max(1, min(EVERY, texts.count() // SAMPLE))
    sample = texts.where(F.pmod("key", F.lit(every)) == 0).dropDuplicates(["key"])
    counted = (
        sample.select(F.explode(shingles(F.col("_t"), width)).alias("s")).groupBy("s").count()
        .where(F.col("count") >= COMMON).orderBy(F.desc("count"), "s").limit(LISTED))
    listed = counted.select("s").toArrow()["s"].to_numpy().astype(np.int64)
    order = np.argsort(listed)
    rank = (len(listed) - order).astype(np.int32)
    return np.append(listed[order], np.iinfo(np.int64).max), np.append(rank, np.int32(0))


def _near(common: Column, a: Column, b: Column) -> Column:
    return common * (NUM + DEN) >= (a + b) * NUM


def _alike(a: Column, b: Column) -> Column:
    """Sizes at which two sets can be near copies."""
    return F.least(a, b) * DEN >= F.greatest(a, b) * NUM


def _fits(n: str, place: str, m: str, other: str) -> Column:
    """Whether sets of ``n`` and ``m`` shingles can be near copies whose first common shingle is at these places."""
    rest = F.least(F.col(n) - F.col(place), F.col(m) - F.col(other))
    return _alike(F.col(n), F.col(m)) & _near(rest, F.col(n), F.col(m))


def _possible(pairs: DataFrame, outlines: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` that can be near copies by ``outlines(d, n, outline)`` of their sets; none that is one is lost."""
    end = lambda name: outlines.select(F.col("d").alias(name), F.col("n").alias(f"n_{name}"), F.col("outline").alias(f"_{name}"))
    both = pairs.join(end("u"), "u").join(end("v"), "v").where(_alike(F.col("n_u"), F.col("n_v")))
    apart = both.select("u", "v", (F.col("n_u") + F.col("n_v")).alias("n"), differing(F.col("_u"), F.col("_v")).alias("apart"))
    return apart.where(_near(F.col("n") - F.col("apart"), F.col("n"), F.col("n"))).select("u", "v")


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, outlines: DataFrame, width: int) -> DataFrame:
    """The pairs ``(u, v)`` that are near copies, by their whole sets."""
    pairs = materialize(_possible(pairs, outlines), "possible")
    sets = _sets(texts, classes, pairs, width)
    one = sets.select(F.col("d").alias("u"), F.col("set").alias("_u"))
    two = sets.select(F.col("d").alias("v"), F.col("set").alias("_v"))
    # heads are few beside the pairs: where their sets are small they are broadcast, and no pair carries one through a shuffle
    heads = materialize(one.join(pairs.select("u").distinct(), "u"), "head_sets")
    entries = heads.agg(F.sum(F.size("_u"))).first()[0] or 0
    heads = F.broadcast(heads) if entries * 8 <= HEAD_BYTES else heads
    both = pairs.join(two, "v").join(heads, "u").select(
        "u", "v", F.size("_u").cast("long").alias("a"), F.size("_v").cast("long").alias("b"),
        F.size(F.array_intersect("_u", "_v")).cast("long").alias("i"))
    found = materialize(both.where(_near(F.col("i"), F.col("a"), F.col("b"))).select("u", "v"), "verified")
    discard(sets, pairs)
    return found


def _sets(texts: DataFrame, classes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """``(d, set)`` of the texts in ``pairs``."""
    named = pairs.select(F.explode(F.array("u", "v")).alias("d")).distinct().join(classes, "d")
    wanted = bounded(materialize(
        named.select("d", "rows", F.col("least.id").alias("_id"), F.col("least.key").alias("_key")), "compared"))
    found = texts.join(wanted, texts["id"].eqNullSafe(wanted["_id"]) & (texts["key"] == wanted["_key"]))
    found = found.where("rows = 1").unionByName(found.where("rows > 1").dropDuplicates(["d"]))
    return materialize(found.select("d", shingles(F.col("_t"), width).alias("set")), "sets")


def _closest(classes: DataFrame) -> DataFrame:
    """Candidates ``(u, v)`` of ``classes(d, fp)`` whose fingerprints differ in two bits or fewer: each text with
    the least of its fingerprint, and the least ones of near fingerprints."""
    least = materialize(classes.groupBy("fp").agg(F.min("d").alias("rep")), "fingerprints")
    near = materialize(simhash.links(least.select("fp")), "near_fingerprints")
    end = lambda name: least.select(F.col("fp").alias(f"_{name}"), F.col("rep").alias(name))
    across = near.select(F.col("u").alias("_u"), F.col("v").alias("_v")).join(end("u"), "_u").join(end("v"), "_v").select("u", "v")
    same = classes.join(least, "fp").where("d <> rep").select(F.col("rep").alias("u"), F.col("d").alias("v"))
    return across.unionByName(same).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``(id, key, rep_id, rep_key)`` for every row of ``docs``; ``key`` tells texts of equal ids apart.

    Two texts are linked if the Jaccard similarity of their sets of ``width``-word shingles (A-Z folded, split
    at ASCII white space) is 0.8 or more. The representative of a class of linked texts is its row with the
    smallest id, then key; one without an id only where no row of the class has one. Null, empty and wordless
    texts are copies of each other. An empty table gives an empty result. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("id"), row_key(F.col(text_col)).alias("key"), F.col(text_col).alias("_t"))
    common, rank = common_shingles(texts, width)
    marked = materialize(
        texts.select("id", "key", sketch(F.col("_t"), width, common, rank).alias("s")).select("id", "key", "s.*"), "sketches")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    classes = materialize(
        marked.groupBy("d").agg(F.min(place).alias("least"), F.count("*").alias("rows"), F.min("fp").alias("fp")), "classes")
    # one row speaks for texts of the same words
    copied = bounded(materialize(
        classes.where("rows > 1").select(F.col("d").alias("_d"), F.col("least.id").alias("_id"), F.col("least.key").alias("_key")), "copied"))
    chosen = marked.join(copied, marked["d"] == copied["_d"], "left")
    spoken = chosen.where(F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).dropDuplicates(["d"])
    single = chosen.where(F.col("_d").isNull()).unionByName(spoken).select("d", F.col("n").cast("long").alias("n"), "prefix", "outline")
    outlines = materialize(single.select("d", "n", "outline"), "outlines")
    postings = single.select("d", "n", F.posexplode("prefix").alias("place", "token"))
    shared = materialize(postings.groupBy("token").agg(F.count("*").alias("_n")).where("_n > 1").select("token"), "shared")
    # most shingles are in one text only; where the shared ones are too many to be broadcast, a bitmap of them keeps these from the shuffle
    held = postings if shared.count() <= BROADCAST_ROWS else likely_members(postings, "token", shared)
    found = materialize(held.join(bounded(shared), "token"), "postings")
    # the member with most shared shingles heads a key: what a group varies heads most of its keys
    degree = materialize(found.groupBy("d").agg(F.count("*").alias("_shared")), "degree")
    ranked = found.join(bounded(degree), "d")
    heads = materialize(
        ranked.groupBy("token").agg(F.max(F.struct("_shared", "d", "n", "place")).alias("h"))
        .select("token", F.col("h.d").alias("head"), F.col("h.n").alias("head_n"), F.col("h.place").alias("head_place")), "heads")
    members = materialize(found.join(bounded(heads), "token"), "members")
    discard(found)
    star = members.where((F.col("d") != F.col("head")) & _fits("n", "place", "head_n", "head_place")).select(
        F.col("head").alias("u"), F.col("d").alias("v"))
    star = materialize(star.unionByName(_closest(classes)).distinct(), "star")
    first = _verified(star, texts, classes, outlines, width)
    # what the heads did not bring together
    part = materialize(connected_components(first).select(F.col("node").alias("d"), "component"), "parts")
    placed = materialize(members.join(part, "d", "left").select(
        "token", "d", "n", "place", F.coalesce("component", "d").alias("part")), "placed")
    apart = materialize(
        placed.groupBy("token").agg(F.min("part").alias("_a"), F.max("part").alias("_b")).where("_a <> _b").select("token"), "apart")
    split = materialize(placed.join(bounded(apart), "token"), "split")
    side = lambda x: split.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("d", "n", "place", "part")])
    rest = side("u").join(side("v"), "token").where("d_u < d_v and part_u <> part_v").where(
        _fits("n_u", "place_u", "n_v", "place_v")).select(F.col("d_u").alias("u"), F.col("d_v").alias("v")).distinct()
    rest = materialize(rest.join(star, ["u", "v"], "left_anti"), "rest")
    second = _verified(rest, texts, classes, outlines, width)
    discard(heads, members, placed, split, star, rest, outlines)
    member = materialize(connected_components(first.unionByName(second)), "components")
    named = member.join(classes, member["node"] == classes["d"])
    groups = named.groupBy("component").agg(F.min("least").alias("rep"))
    linked = member.join(groups, "component").select(F.col("node").alias("d"), "rep")
    labels = materialize(
        classes.join(linked, "d", "left").select("d", F.coalesce("rep", "least").alias("rep")), "labels")
    return marked.select("id", "key", "d").join(labels, "d").select(
        "id", "key", F.col("rep.id").alias("rep_id"), F.col("rep.key").alias("rep_key"))
