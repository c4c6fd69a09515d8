"""Near-duplicate classes by HyperMinHash sketches.

A text is the set of its shingles. Each shingle's hash chooses one of ``BUCKETS`` buckets; a bucket keeps of its
least hash only the number of leading zeros and a few bits of mantissa (Yu and Weber, 2017), 16 bits in all.
Buckets without a shingle borrow from one that has some (Shrivastava, 2017), so texts of any length have full
sketches whose registers agree with the sets' Jaccard similarity as probability. Bands of registers are the equality keys of
the candidate search. Candidates whose similarity, estimated from all registers and corrected for registers
that agree by chance, is far below the threshold are dropped; the others are verified on their whole sets.

Sets, not texts, are compared: texts with one set of shingles collapse first. The members of a band key are
compared with the one of them that shares most keys, so a group of near copies makes no pairs, and then only
where they lie in different components. Keys with more than ``DENSE`` such members go an exact way: the shingles of these
members are counted, and sets that share one of their rarest at fitting positions are compared (prefix
filter), which needs no bands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewsift.llm.common import bounded, per_value
from reviewsift.operators.components import connected_components
from reviewsift.session import materialize

SEED, WIDTH = 42, 4
#: Similarity from which two sets are linked, as a fraction.
NUM, DEN = 4, 5
#: Registers of a sketch (a power of two), bits of mantissa, and how many registers make a band key. Of pairs at
#: the threshold 2 in a million share none of the 42 bands.
BUCKET_BITS, MANTISSA, BAND = 8, 10, 6
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // BAND
#: Standard errors of independent registers by which an estimate may miss the threshold; borrowed registers make
#: that about five of the real ones, so about one link in a million at the threshold is lost.
ERRORS = 6.0
#: Members of a key, in different components, up to which they are compared with each other. Both ways find
#: the same links; the exact way makes fewer rows of a group that lies just below the threshold.
DENSE = 4


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # of bytes: A-Z only, ASCII white space only


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than ``width`` are one shingle, none give none."""
    words = _words(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    first, last = [0, *(ends[:n - 1] + 1).tolist()], ends[len(words) - n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(first, last)), np.uint64, n))


# --- sketches --------------------------------------------------------------------------------

_REST = 64 - BUCKET_BITS
#: For each bucket the others in a fixed random order, in which it looks for one to borrow from.
_PROBES = np.stack([np.random.default_rng(1000 + i).permutation(BUCKETS) for i in range(BUCKETS)])


def _compressed(rest: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of hashes of ``_REST`` bits: a small floating-point number in 16 bits."""
    value = np.maximum(rest, np.uint64(1))
    high = value >> np.uint64(4)  # few enough bits for a double
    exponent = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 4, np.frexp(value.astype(np.float64))[1]).astype(np.int64)
    shift = exponent - 1 - MANTISSA
    mantissa = np.where(shift >= 0, value >> np.maximum(shift, 0).astype(np.uint64),
                        value << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    return ((_REST - exponent) << MANTISSA | mantissa.astype(np.int64)).astype(np.uint16)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a non-empty sorted set."""
    bucket = (shingles >> np.uint64(_REST)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])  # sorted, so the least of each bucket
    least = _compressed(shingles[first] & np.uint64((1 << _REST) - 1))
    registers, filled = np.zeros(BUCKETS, np.uint16), np.zeros(BUCKETS, bool)
    registers[bucket[first]], filled[bucket[first]] = least, True
    empty = np.flatnonzero(~filled)
    if len(empty):
        lender = _PROBES[empty, filled[_PROBES[empty]].argmax(axis=1)]
        registers[empty] = registers[lender]
    return registers


def _by_chance(parts: int = 16) -> np.ndarray:
    """Probability that registers of different least hashes agree, by the sizes (powers of two) of both sets.

    Each power of two is cut into ``parts``, in which the mantissa's cells are equally likely.
    """
    rate = 2.0 ** (np.arange(0, 33) - BUCKET_BITS)[:, None]  # shingles a bucket
    zeros, part = np.arange(0, _REST - MANTISSA), np.arange(parts)
    low = 2.0 ** (-1.0 - zeros)[:, None] * (1 + part / parts)[None, :]
    high = low + 2.0 ** (-1.0 - zeros)[:, None] / parts
    share = np.exp(-rate * low.ravel()) - np.exp(-rate * high.ravel())
    share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
    return share @ share.T * parts / (1 << MANTISSA)


_CHANCE = _by_chance()


def estimate(agree: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the part of registers that agree, less what agrees by chance."""
    step = lambda n: np.clip(np.round(np.log2(np.maximum(n, 1))), 0, len(_CHANCE) - 1).astype(np.int64)
    chance = _CHANCE[step(sizes_a), step(sizes_b)]
    return np.clip((agree / BUCKETS - chance) / (1 - chance), 0, 1)


_SKETCH = pa.struct([("d", pa.int64()), ("n", pa.int64()), ("registers", pa.binary())])


def _sketched(text: bytes | None, width: int) -> dict:
    found = shingle_set(text, width)
    if not len(found):
        return {"d": None, "n": 0, "registers": None}
    name = np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64)
    return {"d": name, "n": len(found), "registers": sketch(found).tobytes()}


def sketches(text: Column, width: int = WIDTH) -> Column:
    """``d`` (hash of the whole set), ``n`` (its size) and ``registers``; no name and no registers without words."""

    @F.arrow_udf("struct<d long, n long, registers binary>")
    def sketched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return per_value(batches, _SKETCH, lambda texts: [_sketched(t, width) for t in texts])

    return sketched(text.cast("binary"))


def shingle_sets(text: Column, width: int = WIDTH) -> Column:
    """Sorted array of the shingles' hashes."""

    @F.arrow_udf("array<long>")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return per_value(batches, pa.list_(pa.int64()), lambda texts: [shingle_set(t, width).view(np.int64) for t in texts])

    return sets(text.cast("binary"))


# --- candidates ------------------------------------------------------------------------------

def band_keys(sets: DataFrame) -> DataFrame:
    """``(key, d, n)``: the band keys of each sketch of ``sets(d, n, registers)``."""

    @F.arrow_udf("array<long>")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = np.empty((len(batch), BANDS), np.int64)
            for row, b in enumerate(batch.to_pylist()):
                for band in range(BANDS):
                    at = 2 * BAND * band
                    out[row, band] = np.uint64(xxhash.xxh64_intdigest(b[at:at + 2 * BAND], band)).view(np.int64)
            yield pa.ListArray.from_arrays(np.arange(0, out.size + 1, BANDS, dtype=np.int32), pa.array(out.ravel()))

    return sets.select("d", "n", F.explode(keys("registers")).alias("key")).select("key", "d", "n")


def _alike(a: Column, b: Column) -> Column:
    """Sizes at which two sets can be linked."""
    return F.least(a, b) * DEN >= F.greatest(a, b) * NUM


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` whose sizes allow a link and whose estimated similarity does not speak against it."""
    share = NUM / DEN
    limit = share - ERRORS * (share * (1 - share) / BUCKETS) ** 0.5

    @F.arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        block = lambda x: np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(len(x), BUCKETS)
        agree = np.empty(len(a), np.int64)
        for at in range(0, len(a), 1024):
            agree[at:at + 1024] = (block(a.slice(at, 1024)) == block(b.slice(at, 1024))).sum(axis=1)
        return pa.array(estimate(agree, n.to_numpy(zero_copy_only=False), m.to_numpy(zero_copy_only=False)) >= limit)

    side = lambda name: sets.select(
        F.col("d").alias(name), F.col("n").alias(f"_n{name}"), F.col("registers").alias(f"_r{name}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").where(_alike(F.col("_nu"), F.col("_nv")))
    return both.where(near("_ru", "_rv", "_nu", "_nv")).select("u", "v")


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs ``(u, v)`` that are linked, by their whole sets."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("d")).distinct()
    whole = materialize(_whole_sets(wanted, sets, texts, width), "sets")
    one = whole.select(F.col("d").alias("u"), F.col("set").alias("_u"))
    two = whole.select(F.col("d").alias("v"), F.col("set").alias("_v"))
    common = F.size(F.array_intersect("_u", "_v"))
    both = pairs.join(one, "u").join(two, "v").select("u", "v", common.alias("i"), (F.size("_u") + F.size("_v")).alias("s"))
    return both.where(F.col("i") * (NUM + DEN) >= F.col("s") * NUM).select("u", "v")


def _whole_sets(wanted: DataFrame, sets: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``(d, set)`` of the named sets, from one text each."""
    place = bounded(materialize(sets.join(wanted, "d").select("d", "copies", F.col("place").alias("_place")), "wanted"))
    found = texts.join(place, texts["place"] == place["_place"])
    found = found.where("copies = 1").unionByName(found.where("copies > 1").dropDuplicates(["d"]))
    return found.select("d", shingle_sets(F.col("text"), width).alias("set"))


def _rare_pairs(members: DataFrame, whole: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of ``members(d, part)`` in different parts that can be linked, exactly.

    Shingles are ordered by how many members have them. Linked sets share one at places behind which enough
    shingles follow in both; a member's shingles that no other has come first and make no row.
    """
    tokens = materialize(whole.select("d", F.size("set").alias("n"), F.explode("set").alias("token")), "tokens")
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    order = Window.partitionBy("d").orderBy("df", "token")
    ranked = tokens.join(materialize(counts, "counts"), "token").select(
        "d", "n", "token", F.row_number().over(order).alias("_at"),
        F.count("*").over(Window.partitionBy("d")).alias("_shared"))
    # place among all its shingles: those of no other member come first
    placed = ranked.withColumn("place", F.col("n") - F.col("_shared") + F.col("_at"))
    placed = placed.where((F.col("n") - F.col("place") + 1) * DEN >= F.col("n") * NUM)
    keyed = materialize(placed.join(members, "d").select("token", "d", "part", "n", "place"), "prefixes")
    a, b = keyed.alias("a"), keyed.alias("b")
    rest = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place")) + 1
    return a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.d") < F.col("b.d")) & (F.col("a.part") != F.col("b.part"))
                  & _alike(F.col("a.n"), F.col("b.n"))
                  & (rest * (NUM + DEN) >= (F.col("a.n") + F.col("b.n")) * NUM)).select(
        F.col("a.d").alias("u"), F.col("b.d").alias("v")).distinct()


def links(sets: DataFrame, texts: DataFrame, width: int = WIDTH, dense: int = DENSE) -> DataFrame:
    """``(u, v)``: linked pairs of ``sets(d, n, registers, place, copies)``; enough of them that two sets are connected by
    these exactly if they are connected by all. ``sets`` and ``texts(place, text)`` are stored tables.
    """
    one = F.struct("d", "n")
    keys = materialize(
        band_keys(sets).groupBy("key").agg(F.count("*").alias("m"), F.min(one).alias("u"), F.max(one).alias("v")).where("m > 1"), "keys")
    larger = bounded(keys.where("m > 2").select("key"))
    members = materialize(band_keys(sets).join(larger, "key"), "members")
    # the member with most shared keys is a key's head: what a group varies heads most of the group's keys
    shared = materialize(members.groupBy("d").agg(F.count("*").alias("_shared")), "shared")
    heads = materialize(members.join(bounded(shared), "d").groupBy("key").agg(F.max(F.struct("_shared", "d", "n")).alias("h"))
                        .select("key", F.col("h.d").alias("head"), F.col("h.n").alias("_n")), "heads")
    led = members.join(bounded(heads), "key").where((F.col("d") != F.col("head")) & _alike(F.col("n"), F.col("_n")))
    star = keys.where((F.col("m") == 2) & _alike(F.col("u.n"), F.col("v.n"))).select(F.col("u.d").alias("u"), F.col("v.d").alias("v"))
    star = star.unionByName(led.select(F.least("d", "head").alias("u"), F.greatest("d", "head").alias("v"))).distinct()
    star = materialize(likely(star, sets), "star")
    first = materialize(verified(star, sets, texts, width), "first")
    # what the heads did not bring together
    part = materialize(connected_components(first).select(F.col("node").alias("d"), "component"), "parts")
    placed = materialize(
        members.join(part, "d", "left").select("key", "d", "n", F.coalesce("component", "d").alias("part")), "placed")
    apart = placed.groupBy("key").agg(F.count("*").alias("m"), F.min("part").alias("_a"), F.max("part").alias("_b")).where("_a <> _b")
    apart = bounded(materialize(apart.select("key", "m"), "apart"))
    split = materialize(placed.join(apart, "key"), "split")
    few = split.where(F.col("m") <= dense)
    side = lambda x: few.select("key", F.col("d").alias(x), F.col("part").alias(f"_p{x}"), F.col("n").alias(f"_n{x}"))
    among = side("u").join(side("v"), "key").where("u < v and _pu <> _pv").where(_alike(F.col("_nu"), F.col("_nv"))).select("u", "v").distinct()
    second = likely(among, sets)
    many = materialize(split.where(F.col("m") > dense).select("d", "part").distinct(), "dense")
    whole = materialize(_whole_sets(many.select("d"), sets, texts, width), "dense-sets")
    third = likely(_rare_pairs(many, whole), sets)
    rest = materialize(second.unionByName(third).distinct().join(star, ["u", "v"], "left_anti"), "rest")
    return first.unionByName(verified(rest, sets, texts, width))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    dense: int = DENSE) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Two texts are linked if the Jaccard similarity of their sets of ``width``-word shingles (A-Z folded, split at
    ASCII white space) is 0.8 or more. ``component_id`` is the smallest id among the rows reachable over links and
    ``kept`` marks the rows that have it. Null, empty and wordless texts have no shingles and are linked with nothing, not
    even with rows of their own id. Rows with a null id take part; they name a component only where no row has
    an id (then null), and are kept only there. Equal ids are one document per text. An empty table gives an
    empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = materialize(
        rows.select("id", F.xxhash64("id", "text").alias("place"), sketches(F.col("text"), width).alias("s"))
        .select("id", "place", "s.*"), "sketches")
    texts = rows.select(F.xxhash64("id", "text").alias("place"), "text")
    # one row speaks for all with its set
    spoken = marked.where("n > 0").groupBy("d").agg(
        F.min("id").alias("least"), F.min("place").alias("place"), F.first("n").alias("n"), F.first("registers").alias("registers"),
        F.count("*").alias("copies"))
    sets = materialize(spoken, "distinct")
    linked = links(sets, texts, width, dense)
    member = materialize(connected_components(linked), "components")
    named = member.join(sets.select("d", "least"), member["node"] == sets["d"])
    groups = named.groupBy("component").agg(F.min("least").alias("group_id"))
    labels = member.join(groups, "component").select(F.col("node").alias("d"), "group_id")
    labels = materialize(
        sets.select("d", "least").join(labels, "d", "left").select("d", F.coalesce("group_id", "least").alias("component_id")), "labels")
    wordless = marked.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    out = marked.where("n > 0").join(labels, "d").select("id", F.col("n").alias("n_shingles"), "component_id").unionByName(wordless)
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))

