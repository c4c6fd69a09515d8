"""SimHash classes against brute force."""

import random

import xxhash
from pyspark.sql import functions as F

from reviewsift.llm import simhash


def brute_print(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in low).split(" ") if w]
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    """(id, fingerprint) rows -> smallest id reachable, by comparing all pairs of fingerprints."""
    distinct = sorted(set(p for _, p in prints))
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return [(i, p, least.get(root(p))) for i, p in prints]


def collected(df):
    return sorted(((r.id, r.fp % 2**64, r.component_id) for r in df.collect()), key=str)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
    want = sorted(brute_classes(prints), key=str)
    assert collected(simhash.near_duplicates(docs)) == want
    assert len({c for _, _, c in want}) < len(want)


def links_of(spark, values, dense):
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    return {tuple(sorted((r.u % 2**64, r.v % 2**64))) for r in simhash.links(df, dense).collect()}


def test_links_connect_what_all_links_connect(spark):
    rng = random.Random(2)
    centre = [rng.getrandbits(64) for _ in range(6)]
    values = set(centre)
    for c in centre[:3]:
        bits = rng.sample(range(64), 9)
        for _ in range(80):
            v = c
            for b in rng.sample(bits, rng.randrange(1, 6)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    for dense in (128, 0):
        got = links_of(spark, values, dense)
        assert all((a ^ b).bit_count() <= 2 for a, b in got)
        want = brute_classes([(v, v) for v in values])
        label = {v: v for v in values}
        changed = True
        while changed:
            changed = False
            for a, b in got:
                m = min(label[a], label[b])
                if label[a] != m or label[b] != m:
                    label[a] = label[b] = m
                    changed = True
        assert [(v, v, label[v]) for v in values] == want


def test_every_pair_at_two_bits_shares_a_variant(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    for i, j in [(0, 63), (31, 32), (5, 5)]:
        near = base ^ (1 << i) if i == j else base ^ (1 << i) ^ (1 << j)
        assert len(links_of(spark, [base, near], 128)) == 1
    assert links_of(spark, [base, base ^ 0b111], 128) == set()


def test_edges(spark):
    schema = "doc_id long, text string, fp string, key string, component_id string, _t int"
    rows = [(5, None, "x", "y", "z", 1), (3, "", "x", "y", "z", 1), (None, "   \n", "x", "y", "z", 1), (7, "one", "", "", "", 0),
            (8, "ONE", "", "", "", 0), (8, "ONE", "", "", "", 0), (9, "two words", "", "", "", 0), (None, "lonely text", "", "", "", 0),
            (11, "word " * 70_000, "", "", "", 0), (10, "Word\tword " * 30_000, "", "", "", 0), (12, "É un", "", "", "", 0)]
    docs = spark.createDataFrame(rows, schema)
    got = collected(simhash.near_duplicates(docs))
    assert got == sorted(brute_classes([(r[0], brute_print(r[1])) for r in rows]), key=str)
    assert (5, 0, 3) in got and (None, 0, 3) in got and got.count((8, brute_print("one"), 7)) == 2
    empty = simhash.near_duplicates(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["id", "fp", "component_id"]


def test_hex(spark):
    row = spark.createDataFrame([(-1,), (0,), (255,)], "fp long").select(simhash.hex_fingerprint(F.col("fp")).alias("h"))
    assert [r.h for r in row.collect()] == ["f" * 16, "0" * 16, "00000000000000ff"]
