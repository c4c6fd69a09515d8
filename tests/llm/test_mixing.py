"""The mix against its closed form: a source's stream is cut at its target."""

import hashlib
import math
import re

import pytest

from reviewsift.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """rows (id, text, source) -> (id, size, source_size, target, taken), by hand."""
    sized = [(i, len(WORD.findall(t or "")), s) for i, t, s in rows]
    sources = sorted({s for *_, s in sized}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for _, n, x in sized if x == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    total, full = sum(size.values()), set()
    while True:
        rest, share = total - sum(3 * size[s] for s in full), sum(weight[s] for s in sources if s not in full)
        target = {s: 3.0 * size[s] if s in full else weight[s] * rest / share for s in sources}
        over = {s for s in sources if s not in full and target[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    out = []
    for s in sources:
        at, quota = 0, math.floor(target[s] + 0.5)
        mine = [(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), n, i) for i, n, x in sized if x == s]
        for _, n, i in sorted(mine, key=lambda r: r[:2]):
            taken = sum(max(0, min(n, quota - p * size[s] - at)) for p in range(4))
            out.append((i, n, size[s], target[s], taken))
            at += n
    return sorted(out, key=str)


def collected(df):
    return sorted(((r.id, r["size"], r.source_size, pytest.approx(r.target), r.taken) for r in df.collect()), key=str)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text, r.source) for r in docs.collect()])
    for block in (512, 7):
        got = collected(mixing.mix_sources(docs, block=block))
        assert sorted(got, key=lambda r: str(r[0])) == sorted(want, key=lambda r: str(r[0]))
    assert sum(r[4] for r in want) == pytest.approx(sum(r[1] for r in want), abs=20)


def test_edges(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (None, "q " * 50, "z"), (5, "w\x1cw w", None),
            (6, "big " * 30_000, "ä"), (7, "tiny", "only"), (8, "", "empty")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, source string, number int, row string")
    got = mixing.mix_sources(df)
    assert [(r[0], r[1], r[2], r[4]) for r in collected(got)] == [(r[0], r[1], r[2], r[4]) for r in brute(rows)]
    for r in got.collect():
        assert r.taken <= 3 * r["size"]
    assert mixing.mix_sources(df.limit(0)).count() == 0
    nothing = mixing.mix_sources(df.where("text = '' OR text IS NULL"))
    assert {(r["size"], r.target, r.taken) for r in nothing.collect()} == {(0, 0.0, 0)}


def test_water_fill():
    assert mixing.water_fill([100, 100], [1, 1]) == [100, 100]
    assert mixing.water_fill([10, 190], [5, 1]) == [30, 170]
    assert sum(mixing.water_fill([1, 2, 4, 8, 1000], [5, 2, 1, 5, 2])) == pytest.approx(1015)
    assert mixing.water_fill([0, 0], [1, 2]) == [0, 0]


def test_schedule_is_even_everywhere(spark):
    sources = spark.createDataFrame(
        [(0, "a", 50_000, 60_000.0), (1, "b", 30_000, 15_000.0), (2, "c", 10_000, 25_000.0), (3, "d", 0, 0.0)],
        "number int, source string, source_size long, target double")
    slots = mixing.schedule(sources, 100).orderBy("slot").collect()
    assert len(slots) == 1000
    order = [s.number for s in slots]
    for n, share in ((0, 0.6), (1, 0.15), (2, 0.25)):
        for upto in range(50, 1000, 50):
            assert abs(order[:upto].count(n) - share * upto) <= 6
        mine = [s for s in slots if s.number == n]
        assert [s["rank"] for s in mine] == list(range(len(mine)))


def test_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert collected(mixing.mix_sources(docs)) == collected(mixing.mix_sources(docs.repartition(5)))
