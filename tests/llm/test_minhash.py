"""Components against all pairs, sketches against what they estimate."""

import random

import numpy as np
import pytest

from reviewsift.llm import minhash
from reviewsift.session import materialize


def brute_set(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in low).split(" ") if w]
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows):
    """rows (id, text) -> sorted (id, n_shingles, component_id, kept)."""
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        least.setdefault(root(i), []).append(id_)
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in least.items()}
    return sorted(((id_, len(sets[i]), least[root(i)], id_ == least[root(i)]) for i, (id_, _) in enumerate(rows)), key=str)


def collected(df):
    return sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def varied(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
    return words


def made():
    """Groups of near copies at all distances, chains of them, a common line, short and wordless texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    line = " ".join(word() for _ in range(30))
    texts = [None, "", " \n", "One two", "one  TWO", "one two three four", "one two three four five",
             "a b c d e f g h", "a b c d e f g h i", "A b\tc d e f g h i j"]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(20, 160))]
        for _ in range(8):
            texts.append(" ".join(varied(rng, base, rng.randrange(6))))
        for _ in range(5):  # each a step farther from the first
            base = varied(rng, base, 2)
            texts.append(" ".join(base))
    base = [word() for _ in range(120)]
    texts += [" ".join(varied(rng, base, rng.randrange(9))) for _ in range(150)]  # one large group at all distances
    texts += [f"{line} " + " ".join(word() for _ in range(rng.randrange(10, 60))) for _ in range(40)]
    return texts + [f"{line} {word()}" for _ in range(10)]


@pytest.mark.parametrize("dense", [minhash.DENSE, 2])
def test_components_are_those_of_all_pairs(spark, dense):
    rows = list(enumerate(made()))
    want = brute(rows)
    assert 20 < len({r[2] for r in want}) < len(rows) - 50
    assert collected(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), dense=dense)) == want


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert collected(minhash.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_registers_are_zeros_and_mantissa():
    rng = np.random.default_rng(1)
    values = [*rng.integers(1, 2**56, 500).tolist(), 1, 2, 3, 2**53 + 1, 2**56 - 1, *(1 << i for i in range(56))]
    values = np.array(values, np.uint64)
    for v, got in zip(values.tolist(), minhash._compressed(values).tolist()):
        bits = v.bit_length()
        mantissa = (v << 64 >> (bits - 1 + 64 - minhash.MANTISSA)) & (2**minhash.MANTISSA - 1)
        assert got == (56 - bits) << minhash.MANTISSA | mantissa


@pytest.mark.parametrize("n", [5, 40, 300, 5000])
def test_estimates(n):
    rng = np.random.default_rng(n)
    off = []
    for _ in range(60):
        share = rng.integers(0, n + 1)
        pool = np.unique(rng.integers(0, 2**64 - 1, 2 * n - share, np.uint64))
        a, b = np.sort(rng.permutation(pool)), None
        a, b = np.sort(a[:n]), np.sort(a[n - share:])
        true = share / (2 * n - share)
        agree = (minhash.sketch(a) == minhash.sketch(b)).sum()
        off.append(float(minhash.estimate(np.array([agree]), np.array([len(a)]), np.array([len(b)]))[0]) - true)
    assert abs(np.mean(off)) < 0.015 and np.abs(off).max() < 0.2


def test_a_group_of_texts_below_the_threshold_makes_no_pairs(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = {m: None for m in (100, 400)}
    for m in rows:
        texts = []
        for _ in range(m):  # four words far from each other are new, so three in four shingles are common to two
            new = {30 * i + rng.randrange(4, 20): f"new{rng.randrange(10 ** 6)}" for i in range(4)}
            texts.append(" ".join(new.get(i, w) for i, w in enumerate(base)))
        docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "place long, d long, text string")
        whole = materialize(docs.select("d", minhash.shingle_sets(docs["text"]).alias("set")), "t")
        rows[m] = minhash._rare_pairs(docs.selectExpr("d", "d as part"), whole).count()
    assert rows[400] <= 400


def test_edges(spark):
    rng = random.Random(2)
    a, b, c = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(3))
    long = " ".join(f"x{i}" for i in range(200_000))
    rows = [(7, a), (3, a), (3, a), (None, a), (None, b), (None, b + " more"), (5, c), (5, c), (6, None), (6, ""), (None, None), (8, long), (9, long + " end")]
    docs = spark.createDataFrame([(*r, 1, "r", 2) for r in rows], "doc_id long, text string, d int, registers string, n int")
    want = [(i, n, c, k) if i is not None else (i, n, c, c is None) for i, n, c, k in brute(rows)]
    # a wordless row is linked with nothing
    assert collected(minhash.near_duplicates(docs)) == sorted(want, key=str)
    none = minhash.near_duplicates(docs.limit(0))
    assert none.count() == 0 and none.columns == ["id", "n_shingles", "component_id", "kept"]
