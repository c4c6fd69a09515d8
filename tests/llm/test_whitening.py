"""Components against a dense eigensolver, whole results against a computation by hand."""

import math

import numpy as np
import pytest

from reviewsift.llm import whitening


def brute(rows, count=16):
    """rows (id, vector) -> {(id, component): (n, deviation, |whitened|, explained)}."""
    good = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(count, int((e > e[0] * 1e-12).sum())) if e[0] > 0 else 0
    out = []
    for i, x in good:
        away = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        white = (np.array(x, float) - np.array([s / n for s in sums])) @ u[:, :k] / np.sqrt(e[:k])
        out += [(i, c + 1, n, away, abs(white[c]), e[c] / np.trace(v)) for c in range(k)]
    return out


def collected(df):
    rows = df.collect()
    assert all(r.identity_error <= 1e-8 for r in rows)
    return [(r.id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in rows]


def alike(got, want):
    key = lambda r: (str(r[0]), r[1], r[3])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-6, atol=1e-7)


def test_embeddings(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = whitening.whiten(table)
    alike(collected(got), brute([(r.vec_id, r.embedding) for r in table.collect()]))
    by = {}
    for r in got.collect():
        by.setdefault(r.component, set()).add((r.explained, r.identity_error))
    assert sorted(by) == list(range(1, 17)) and all(len(s) == 1 for s in by.values())
    parts = [next(iter(by[c]))[0] for c in sorted(by)]
    assert parts == sorted(parts, reverse=True) and sum(parts) <= 1 + 1e-12


@pytest.mark.parametrize("kind", ["noise", "low_rank", "repeated", "scales", "diagonal", "negative"])
def test_feast_finds_what_a_dense_solver_finds(kind):
    rng = np.random.default_rng(3)
    d = 40
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = {
        "noise": 1 + rng.random(d), "low_rank": np.r_[5, 4, 3, np.zeros(d - 3)], "repeated": np.repeat([9.0, 4, 1, 0.5], 10),
        "scales": 10.0 ** -np.arange(d), "diagonal": np.arange(1, d + 1) / 8, "negative": rng.standard_normal(d),
    }[kind]
    if kind == "diagonal":
        q = np.eye(d)
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    want = np.sort(np.linalg.eigvalsh(v))[::-1]
    for shift in (*(want[[0, 5, 20]] + 0.011), 0.3):
        assert whitening.inertia(v, shift) == (want < shift).sum()
    got, vectors = whitening.components(v, 16)
    assert len(got) == min(16, (want > 1e-11 * want[0] * 1.01).sum())
    assert np.allclose(got, want[:len(got)], rtol=1e-12, atol=1e-13 * want[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-9
    assert np.abs(v @ vectors - vectors * got).max() < 1e-12 * want[0]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25, 1.0]), (1, [0.5, -0.25, 1.0]), (None, [0.5, 0.125, 2.0]), (2, [4.0, 0.1, -3.0]), (3, [1.0, 1.0, 9.0]),
            (4, None), (5, [nan, 1.0, 1.0]), (6, [inf, 0.0, 0.0]), (7, [None, 1.0, 1.0]), (8, []), (9, [1e9, -2e9, 3.5])]
    odd = [(10, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as n", "'a' as x", "2 as component")
    want = brute(rows[:-1])
    alike(collected(whitening.whiten(df.where("vec_id is null or vec_id <> 9"))), want)
    alike(collected(whitening.whiten(spark.createDataFrame(rows[:-1] + odd, schema))), want)
    with pytest.raises(Exception, match="does not fit a long"):
        whitening.whiten(df).collect()
    for few in (rows[:2], rows[5:8], []):
        none = whitening.whiten(spark.createDataFrame(few, schema))
        assert none.count() == 0 and none.columns == [
            "id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_sums_are_exact():
    x = np.array([[2**30, -5], [7, 2**28]])
    sums = [2**30 + 7, 2**28 - 5]
    assert whitening._deviations(x, 2, sums).tolist() == [
        sum((2 * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]
