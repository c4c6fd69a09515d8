"""Classes of similar texts against brute force."""

import random

import corpus_pipeline as cp
from reviewsift.llm import neardup


def brute_set(text, width=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in low).split(" ") if w]
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def brute_classes(rows):
    """Sorted lists of row numbers that similarities of 0.8 or more connect."""
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[root(i)] = root(j)
    found = {}
    for i in range(len(rows)):
        found.setdefault(root(i), []).append(i)
    return sorted(found.values())


def varied(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
    return words


def texts_of():
    """Near copies at all distances, chains of them, a common line, short and wordless texts."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    line = " ".join(word() for _ in range(30))
    texts = [None, "", " \n", "One two", "one  TWO", "one two three four five", "one two three four five six"]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(20, 160))]
        for _ in range(8):
            texts.append(" ".join(varied(rng, base, rng.randrange(6))))
        for _ in range(5):  # each a step farther from the first
            base = varied(rng, base, 2)
            texts.append(" ".join(base))
    texts += [f"{line} " + " ".join(word() for _ in range(rng.randrange(10, 60))) for _ in range(40)]
    return texts + [f"{line} {word()}" for _ in range(10)]


def grouped(df):
    found = {}
    for r in df.collect():
        found.setdefault((r.rep_id, r.rep_key), []).append(r.id)
    assert all(min(ids) == rep for (rep, _), ids in found.items())
    return sorted(sorted(ids) for ids in found.values())


def test_classes_are_those_of_all_pairs(spark):
    rows = list(enumerate(texts_of()))
    want = brute_classes(rows)
    assert 20 < len(want) < len(rows) - 50
    assert grouped(neardup.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = sorted(sorted(rows[i][0] for i in ids) for ids in brute_classes(rows))
    assert grouped(neardup.similar_classes(docs)) == want


def test_the_stage_drops_near_copies_beyond_two_bits(spark, sf):
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    near = [f"other{i}" if i % 50 == 20 else w for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(varied(rng, base, 60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.drop_near_duplicates(spark, docs, sf).collect()) == [1, 3]


def test_the_stage_drops_rows_not_ids(spark, sf):
    rng = random.Random(2)
    a, b, c, d = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(4))
    rows = [(1, a), (None, a), (None, b),  # b is unique
            (2, a + " more"), (2, c),  # c is unique
            (3, d), (3, d + " more"), (4, d), (3, d),  # one class of which two texts have the smallest id
            (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, docs, sf).collect()), key=str)
    (of_d,) = [t for i, t in got if i == 3]
    assert of_d in (d, d + " more")
    assert len(got) == 5 and {(1, a), (None, b), (2, c)} <= set(got)


def test_no_rows(spark):
    got = neardup.similar_classes(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0 and got.columns == ["id", "key", "rep_id", "rep_key"]


def test_fingerprints_are_those_of_the_simhash_operator(spark):
    from reviewsift.llm import simhash
    texts = [t for t in texts_of()[3:60]]
    for t in texts:
        words = neardup._words(t.encode())
        assert neardup._fingerprint(neardup._hashes(words, 5)) == simhash._simhash(t.encode(), 5)


def test_a_group_below_the_threshold_makes_few_candidates(spark, monkeypatch):
    """Texts at four new words of 120 from one base are no near copies of each other; their pairs must not be made."""
    compared = {}
    real = neardup._verified
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    for m in (100, 400):
        texts = []
        for _ in range(m):
            new = {30 * i + rng.randrange(4, 20): f"new{rng.randrange(10 ** 6)}" for i in range(4)}
            texts.append(" ".join(new.get(i, w) for i, w in enumerate(base)))
        seen = []
        monkeypatch.setattr(neardup, "_verified", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
        got = neardup.similar_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert got.select("rep_id").distinct().count() == m
        compared[m] = sum(seen)
    assert compared[400] <= 4 * 400


def test_outlines_bound_the_difference_of_sets():
    rng = random.Random(5)
    for n in (1, 3, 60, 64, 65, 300, 1000):
        for m in (1, 64, 70, 500, 1100):
            common = [rng.getrandbits(63) for _ in range(min(n, m) * 9 // 10)]
            sets = [neardup.np.unique(neardup.np.array(common + [rng.getrandbits(63) for _ in range(k - len(common))], "int64")) for k in (n, m)]
            apart = neardup._differing(*map(neardup._outline, sets))
            assert apart == neardup._differing(*map(neardup._outline, sets[::-1]))
            assert apart <= len(set(sets[0].tolist()) ^ set(sets[1].tolist()))


def test_texts_far_apart_meet_without_their_sets(spark, monkeypatch):
    """Pairs with half of their words in common are candidates; none is a near copy, and the sets of few are read."""
    rng = random.Random(6)
    texts = []
    for i in range(50):
        half = " ".join(f"half{i}_{n}" for n in range(60))
        texts += [f"{half} " + " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(60)) for _ in range(2)]
    candidates, read = [], []
    verified, sets = neardup._verified, neardup._sets
    monkeypatch.setattr(neardup, "_verified", lambda pairs, *a: candidates.append(pairs.count()) or verified(pairs, *a))
    monkeypatch.setattr(neardup, "_sets", lambda t, c, pairs, w: read.append(pairs.count()) or sets(t, c, pairs, w))
    got = neardup.similar_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got.select("rep_id").distinct().count() == 100
    assert sum(candidates) >= 40 and sum(read) <= sum(candidates) // 10


def test_a_bitmap_of_shared_shingles_loses_none(spark, monkeypatch):
    rows = list(enumerate(texts_of()))
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    assert grouped(neardup.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_classes(rows)
