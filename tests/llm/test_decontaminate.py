"""Benchmark windows against brute force."""

import hashlib
import re

from reviewsift.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + width]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        names = sorted(str(f) for f in found if f is not None)
        out.append((doc, len(w), len(hit), names, bool(hit)))
    return sorted(out, key=str)


def collected(df):
    return sorted(((r.id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in df.collect()), key=str)


def test_documents(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert collected(d.decontaminate(docs, items)) == want
    assert any(r[4] for r in want)


def test_edges(spark):
    alpha = "a b c d e f g h i j k l m n"
    items = [(1, alpha), (2, "Exactly Two"), (3, "solo"), (4, None), (5, "... !!"), (6, alpha.upper()), (None, "x1 x2 x3 x4"),
             (10, "w w w w w w w w w w w w"), (7, "solo")]
    docs = [(1, "zz a b c d e f g h i j zz"), (2, "b c d e f g h i j k l, and exactly--two SOLO"), (3, None), (4, ""), (5, "a b c"),
            (6, "x0 x1 x2 x3 x4 x1 x2 x3"), (7, "w " * 25), (7, "other text"), (7, "other text"), (None, "solo solo"),
            (8, "é" * 5 + " solo " + "no " * 60_000), (9, "a b c d e f g h i é"), (11, "w " * 9)]
    df = spark.createDataFrame([(*r, "c", 1) for r in docs], "doc_id long, text string, id string, window int")
    bench = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, key int")
    assert collected(d.decontaminate(df, bench)) == brute(docs, items)
    assert collected(d.decontaminate(df, bench.limit(0))) == brute(docs, [])
    assert d.decontaminate(df.limit(0), bench).count() == 0


def test_digest(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(["1", "10", "2"],), ([],)], "items array<string>").select(d.items_digest(F.col("items")).alias("h"))
    assert [r.h for r in rows.collect()] == [hashlib.sha256(b"1,10,2").hexdigest(), hashlib.sha256(b"").hexdigest()]
