"""The draw against a plain computation by hand."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from reviewsift.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, least, most):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return len(words), [" ".join(words[i:i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, least=1, most=1, buckets=10_000, least_words=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    source, wanted = Counter(), Counter()
    for _, t in rows:
        source.update(map(bucket, features(t, least, most)[1]))
    for t in target:
        wanted.update(map(bucket, features(t, least, most)[1]))
    s, t = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets))))
    out = []
    for id_, text in rows:
        words, found = features(text, least, most)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        out.append([id_, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    could = sorted((r for r in out if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(could[:percent * len(could) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


def collected(df):
    return sorted(((r.id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def made(n=150):
    rng = random.Random(4)
    words = ["Ärger", "naïve", "x1", "THE", "of", "漢字", *(f"w{i}" for i in range(60))]
    gaps = [" ", ", ", "\n", "\x00", "--"]
    return [(i, "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(60)))) for i in range(n)]


def test_unigrams_and_longer_runs(spark):
    rows = made()
    target = [t for _, t in made(20)] + [None, "w1 w2 w3"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    for least, most in ((1, 1), (1, 2), (2, 3)):
        got = resample.importance_resample(docs, bench, least=least, most=most)
        assert collected(got) == brute(rows, target, least, most)


def test_slabs_give_the_features_of_the_whole():
    texts = [(t or "").encode() for _, t in made(40)] + [b"", None, b"one"]
    for least, most in ((1, 1), (1, 3), (2, 2)):
        count = {}
        for slab in (1, 7, 64, 1 << 20):
            bucket_of = resample._Buckets(977)
            found, words = Counter(), Counter()
            for fresh, whose, where in resample.batch_features(texts, least, most, bucket_of, slab):
                words.update(fresh.tolist())
                found.update(zip(whose.tolist(), where.tolist()))
            count[slab] = (found, words)
        assert all(c == count[1 << 20] for c in count.values())
        want = Counter((i, zlib.crc32(f.encode()) % 977) for i, t in enumerate(texts) for f in features((t or b"").decode(), least, most)[1])
        assert count[1][0] == want


def test_edges(spark):
    long = "word " * 400_000
    same = "alpha beta " * 15
    rows = [(1, same), (1, same), (2, same), (None, same), (None, None), (3, None), (4, ""), (5, " \n"), (6, long)] + [
        (10 + i, same + f"w{i}") for i in range(40)]
    docs = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, words int, _m string")
    bench = spark.createDataFrame([("beta gamma",)], "text string")
    got = collected(resample.importance_resample(docs, bench))
    want = brute(rows, ["beta gamma"])
    assert [r[:4] for r in got] == [r[:4] for r in want] and len(got) == len(rows)
    assert sorted(r[4] for r in got if r[4]) == [1, 2, 3, 4]
    none = bench.limit(0)
    assert collected(resample.importance_resample(docs, none)) and resample.importance_resample(docs.limit(0), bench).count() == 0


def test_all_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None,)], "text string")
    assert [r[1:3] for r in collected(resample.importance_resample(docs, bench))] == [(0, 0), (0, 0)]
