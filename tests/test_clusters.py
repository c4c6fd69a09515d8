"""Grid DBSCAN, nearest core and k-distance against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewsift import fixtures as fx
from reviewsift.operators import dbscan as D, grid as G, kdtree as K, nearest as N
from reviewsift.operators.features import Z_COLUMNS
from reviewsift.plans.detection import cluster_summary, detect_anomalies
from reviewsift.schemas import FEATURES
from reviewsift.session import materialize


def frame(spark, x):
    rows = [(i, int(r[0]), bool(r[1]), bool(r[2]), float(r[3]), int(r[4]), float(r[5])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, helpful_vote long, verified_purchase boolean, has_images boolean, "
                                 "rating_diff double, reviewer_review_count long, rating_vs_product_avg_abs double").repartition(4)


def blobs(seed, n=400):
    """Two crowded spots, one far thin cloud and copies of single rows."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([
        rng.poisson(2, n), rng.random(n) < 0.6, rng.random(n) < 0.3, rng.random(n) * 2,
        rng.integers(1, 9, n), np.round(rng.random(n) * 3, 1)]).astype(float)
    x[: n // 4, [0, 3, 4, 5]] = np.array([0, 0.1, 1, 0.1]) + rng.normal(0, 0.01, (n // 4, 4)) * [0, 1, 0, 1]
    x[n // 4: n // 3] = x[n // 4]
    x[-6:, 0] += [50, 80, 80, 120, 300, 301]
    return x


def scaled(x):
    std = x.std(0)
    return (x - x.mean(0)) / np.where(std == 0, 1, std)


def brute(z, eps, m):
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    near = d <= eps
    core = near.sum(1) >= m
    label = np.full(len(z), -1)
    current = 0
    for i in range(len(z)):
        if core[i] and label[i] < 0:
            stack = [i]
            label[i] = current
            while stack:
                p = stack.pop()
                if core[p]:
                    for q in np.flatnonzero(near[p] & (label < 0)):
                        label[q] = current
                        stack.append(q)
            current += 1
    return d, near, core, label


@pytest.mark.parametrize("seed, eps, m", [(0, 0.6, 8), (1, 0.25, 5), (2, 2.6, 20)])
def test_labels_ranks_and_noise(spark, seed, eps, m):
    x = blobs(seed)
    d, near, core, label = brute(scaled(x), eps, m)
    c = D.dbscan(frame(spark, x), eps, m)
    got = c.labels().toPandas().sort_values("row_id")
    assert got.row_id.tolist() == list(range(len(x)))
    assert got.cluster.tolist() == label.tolist()
    assert got.kind.tolist() == np.where(core, "core", np.where(label >= 0, "border", "noise")).tolist()
    counts = c.neighbour_counts().toPandas().sort_values("row_id")
    assert counts.neighbours.tolist() == near.sum(1).tolist()
    assert counts.is_core.tolist() == core.tolist()
    assert c.core_flags().toPandas().sort_values("row_id").is_core.tolist() == core.tolist()
    noise = np.flatnonzero(label == -1)
    ranked = N.rank_anomalies(c).toPandas().sort_values("rank")
    assert sorted(ranked.row_id) == noise.tolist()
    if len(noise) and core.any():
        far = d[noise][:, core].min(1)
        assert np.allclose(ranked.min_dist, np.sort(far)[::-1])
        assert np.allclose(ranked.set_index("row_id").min_dist[noise], far)


def test_undecided_dense_cells_are_refined(spark, monkeypatch):
    """Long chains of crowded cells, with every small leftover forced through the refinement."""
    monkeypatch.setattr(D, "PAIR_LIMIT", 1)
    monkeypatch.setattr(D, "rep_distance", lambda a, b: F.lit(1e9))
    rng = np.random.default_rng(8)
    n = 600
    x = np.zeros((n, 6))
    x[:, 3] = np.concatenate([rng.random(n // 2), 3 + rng.random(n // 2)])
    x[:, 5] = rng.random(n)
    for eps in (0.08,):
        *_, label = brute(scaled(x), eps, 4)
        got = D.dbscan(frame(spark, x), eps, 4).labels().toPandas().sort_values("row_id")
        assert got.cluster.tolist() == label.tolist()


def test_blocks_of_large_cells(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ROWS", 7)
    monkeypatch.setattr(N, "BLOCK_ROWS", 7)
    x = blobs(11)
    d, _, core, label = brute(scaled(x), 0.6, 8)
    ranked = N.rank_anomalies(D.dbscan(frame(spark, x), 0.6, 8)).toPandas().set_index("row_id")
    noise = np.flatnonzero(label == -1)
    assert np.allclose(ranked.min_dist[noise], d[noise][:, core].min(1))


def test_batches(spark):
    x = blobs(6)
    z, size = scaled(x), 150
    c = D.dbscan(frame(spark, x), 0.6, 8, batch_size=size)
    got = c.labels().toPandas().sort_values("row_id")
    expected = np.concatenate([brute(z[i:i + size], 0.6, 8)[3] for i in range(0, len(z), size)])
    assert got.cluster.tolist() == expected.tolist()
    assert got.batch_id.tolist() == [i // size for i in range(len(z))]
    ranked = N.rank_anomalies(c).toPandas().sort_values("rank")
    assert ranked.batch_id.is_monotonic_increasing
    assert ranked.groupby("batch_id").batch_rank.apply(lambda s: s.tolist() == list(range(1, len(s) + 1))).all()
    total = cluster_summary(c.labels()).first()
    assert total.clusters == sum(len(set(expected[i:i + size]) - {-1}) for i in range(0, len(z), size))


@pytest.mark.parametrize("eps, seed", [(0.6, 6), (2.5, 14), (0.05, 3)])
def test_batches_of_one_task_and_of_many_give_the_same(spark, monkeypatch, eps, seed):
    df, found = frame(spark, blobs(seed)), []
    for whole in (D.WHOLE_BATCH, 0):
        monkeypatch.setattr(D, "WHOLE_BATCH", whole)
        c = D.dbscan(df, eps, 8, batch_size=130)
        assert isinstance(c, D.BatchClustering) == bool(whole)
        found.append([sorted(map(tuple, t.collect()), key=str) for t in (
            N.rank_anomalies(c), c.core_flags(), c.labels(), c.neighbour_counts(), c.noise)])
    assert found[0] == found[1]


def test_repeated_and_missing_ids_go_by_cells(spark):
    df = frame(spark, blobs(6, 120))
    assert isinstance(D.dbscan(df, 0.6, 8, 50), D.BatchClustering)
    for more in (df.where("row_id = 7"), df.where("row_id = 7").withColumn("row_id", F.lit(None).cast("long"))):
        assert not isinstance(D.dbscan(df.unionByName(more), 0.6, 8, 50), D.BatchClustering)


def test_no_row_of_a_small_batch_is_sent_to_its_neighbour_tiles(spark, monkeypatch):
    monkeypatch.setattr(G.Grid, "near_tiles", lambda *_, **__: pytest.fail("rows are copied"))
    x = blobs(6)
    z, size = scaled(x), 150
    got = N.rank_anomalies(D.dbscan(frame(spark, x), 0.6, 8, size)).toPandas()
    noise = np.concatenate([brute(z[i:i + size], 0.6, 8)[3] == -1 for i in range(0, len(z), size)])
    assert sorted(got.row_id) == np.flatnonzero(noise).tolist()


def test_no_core_row_keeps_row_order(spark):
    x = blobs(7, 60)
    ranked = N.rank_anomalies(D.dbscan(frame(spark, x), 0.01, 50)).orderBy("rank").collect()
    assert [r.row_id for r in ranked] == list(range(60))
    assert all(r.min_dist is None for r in ranked)


def test_no_noise_is_an_empty_result(spark):
    assert detect_anomalies(frame(spark, blobs(7, 60)), 1e3, 2).count() == 0


def test_constant_features(spark):
    x = np.ones((30, 6))
    assert D.dbscan(frame(spark, x), 0.5, 12).labels().where("kind = 'core' and cluster = 0").count() == 30


def test_empty_input(spark):
    assert detect_anomalies(frame(spark, blobs(1, 40)).where("false"), 0.5, 3).count() == 0


def test_neighbours_in_crowded_cells_are_counted_by_finer_boxes(spark, monkeypatch):
    monkeypatch.setattr(D, "LEAF_POINTS", 3)
    x = blobs(4)
    _, near, *_ = brute(scaled(x), 0.5, 8)
    got = D.dbscan(frame(spark, x), 0.5, 8).neighbour_counts().toPandas().sort_values("row_id")
    assert got.neighbours.tolist() == near.sum(1).tolist()


def test_rows_with_a_null_feature_are_left_out(spark):
    x = blobs(6, 120)
    gaps = F.when(F.col("row_id") % 40 != 3, F.col("rating_diff"))
    df = frame(spark, x).withColumn("rating_diff", gaps).withColumn(
        "has_images", F.when(F.col("row_id") != 77, F.col("has_images")))
    full = df.na.drop()
    assert full.count() == 116
    seen = lambda t: sorted(map(tuple, detect_anomalies(t, 0.5, 8).select("row_id", "min_dist", "rank").collect()))
    assert seen(df) == seen(full)
    kth = lambda t: sorted(map(tuple, N.k_distances(t, 4).collect()))
    assert kth(df) == kth(full)


def test_whole_numbers_divide_exactly(spark):
    values = [2**55 + 4, 2**61 - 4, 2**53 + 1, 7, 0]
    got = spark.createDataFrame([(v,) for v in values], "n long").select(
        "n", G.whole(F.col("n"), 4).alias("a"), G.whole(F.col("n"), 2**40 + 3).alias("b")).collect()
    assert all((r.a, r.b) == (r.n // 4, r.n // (2**40 + 3)) for r in got)


def test_ranks_on_a_wide_batched_grid(spark):
    rng = np.random.default_rng(11)
    x = blobs(7, 300)
    x[rng.choice(300, 200, replace=False)] = x[rng.choice(300, 200)]  # copies are the core rows
    x[0, [0, 4]] = 4e6, 9e5  # cell numbers beyond 2**53
    z, eps, m, size = scaled(x), 0.002, 3, 150
    c = D.dbscan(frame(spark, x), eps, m, size)
    assert 4 * 2 * np.prod([float(n) for n in c.grid.cells]) > 2**53
    got = N.rank_anomalies(c).toPandas().set_index("row_id")
    for b in (0, 1):
        part = np.arange(b * size, (b + 1) * size)
        d, _, core, label = brute(z[part], eps, m)
        noise = np.flatnonzero(label == -1)
        assert sorted(got.index[got.batch_id == b]) == part[noise].tolist()
        if core.any():
            assert np.allclose(got.min_dist[part[noise]], d[noise][:, core].min(1))


def test_nearest_core_shuffles_nothing_by_batch_alone(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = N.nearest_core(D.dbscan(frame(spark, blobs(3)), 0.6, 8))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(batch_id#" not in plan.replace("L,", ",") or all(
        "," in part.split(")")[0].split("hashpartitioning(")[-1] for part in plan.split("hashpartitioning(batch_id#")[1:])


def test_few_outliers_do_not_gather_the_table(spark, monkeypatch):
    """Leaves stay small, a leaf that many want is taken in parts, and the result does not depend on the cuts."""
    monkeypatch.setattr(K, "VISITS", 30)
    x = blobs(9)
    d = np.sort(brute(scaled(x), 1, 1)[0], axis=1)
    for leaf in (5, 40, 10_000):
        got = N.k_distances(frame(spark, x), 16, leaf).toPandas().sort_values("row_id")
        assert np.allclose(got.k_distance, d[:, 15], atol=1e-9)


def test_leaves_of_the_tree():
    rng = np.random.default_rng(2)
    points = np.c_[rng.standard_normal((5000, 2)), rng.integers(0, 2, 5000), np.zeros(5000), np.round(rng.random(5000), 1)]
    tree = K.Tree.of(points[:1000], 32)
    found = tree.leaf_of(points)
    assert tree.leaves == 32 and set(found) == set(range(32))
    assert np.bincount(found).max() < 4 * 5000 / 32
    boxes = [(points[found == i].min(0), points[found == i].max(0)) for i in range(32)]
    for i, (lo, hi) in enumerate(boxes):  # boxes of leaves do not overlap beyond their faces
        other = points[found != i]
        assert not ((other > lo) & (other < hi)).all(axis=1).any()
    same = K.Tree.of(np.ones((50, 3)), 8)
    assert same.leaves == 1 and set(same.leaf_of(np.ones((4, 3)))) == {0}
    assert K.Tree.of(np.empty((0, 3)), 1).leaves == 1


def test_k_distances_of_nothing(spark):
    assert N.k_distances(frame(spark, blobs(1, 40)).where("false"), 4).count() == 0


def test_k_distances(spark):
    x = blobs(9)
    d = np.sort(brute(scaled(x), 1, 1)[0], axis=1)
    for k in (1, 16, 400):
        got = N.k_distances(frame(spark, x), k).toPandas().sort_values("row_id")
        assert np.allclose(got.k_distance, d[:, k - 1], atol=1e-9)
    assert N.k_distances(frame(spark, x), 401).where("k_distance is not null").count() == 0
    with pytest.raises(ValueError):
        N.k_distances(frame(spark, x), 0)


@pytest.mark.parametrize("eps, kinds", [(0.6, {"core": 234, "border": 139, "noise": 577}), (0.3, {"noise": 950})])
def test_fixture_counts(spark, sf, eps, kinds):
    table = materialize(fx.enriched(spark, sf), "t")
    got = {r.kind: r["count"] for r in D.dbscan(table, eps, 12).labels().groupBy("kind").count().collect()}
    assert got == kinds


def test_row_layout_does_not_matter(spark):
    x = blobs(10)
    a = N.rank_anomalies(D.dbscan(frame(spark, x), 0.6, 8)).toPandas().sort_values("rank")
    b = N.rank_anomalies(D.dbscan(frame(spark, x).repartition(7, "rating_diff"), 0.6, 8)).toPandas().sort_values("rank")
    assert a.row_id.tolist() == b.row_id.tolist()


def test_too_small_radius_is_an_error(spark):
    with pytest.raises(ValueError, match="too small"):
        D.dbscan(frame(spark, blobs(1)), 1e-9, 3)


def test_larger_radius_has_less_noise(spark):
    x = blobs(12)
    rows = lambda eps: {r.row_id for r in D.dbscan(frame(spark, x), eps, 8).noise.collect()}
    assert rows(0.9) <= rows(0.5)


def test_balls_over_many_chunks_and_batches(spark, monkeypatch):
    monkeypatch.setattr(K, "COMPARED", 60)
    rng = np.random.default_rng(8)
    z = np.unique(np.round(rng.normal(0, 1, (600, 3)), 1), axis=0)
    batch, copies = rng.integers(0, 2, len(z)), rng.integers(1, 4, len(z))
    points = materialize(spark.createDataFrame(
        [(i, int(b), int(c), *map(float, r)) for i, (b, c, r) in enumerate(zip(batch, copies, z))],
        "vid long, batch_id long, copies long, a double, b double, c double"), "points")
    got = K.ball_counts(points, ["a", "b", "c"], 0.49, size=4, leaf=2).toPandas().sort_values("vid")
    near = sum((z[:, None, n] - z[None, :, n]) ** 2 for n in range(3)) <= 0.49
    want = (near & (batch[:, None] == batch)) @ copies
    assert got.vid.tolist() == list(range(len(z))) and got.n.tolist() == want.tolist()


def test_neighbour_counts_store_no_row_per_point_and_box(spark, monkeypatch):
    sizes = []

    def counting(df, name):
        stored = materialize(df, name)
        sizes.append(stored.count())
        return stored

    n = 3000
    x = np.random.default_rng(9).random((n, 6)) * [20, 0, 0, 2, 20, 3]
    c = D.dbscan(frame(spark, x), 1.0, 8)
    for module in (D, K):
        monkeypatch.setattr(module, "materialize", counting)
    assert c.neighbour_counts().count() == n
    assert max(sizes) <= n  # before, a table of pairs held several times as many
