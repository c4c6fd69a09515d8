"""The streamed quota against the batch operators on the same files."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from reviewsift import fixtures as fx
from reviewsift.operators.dedup import drop_duplicate_rows
from reviewsift.operators.validate import valid_reviews
from reviewsift.session import materialize
from reviewsift.streaming import quota as Q


def batch_result(raw, n):
    order = Window.partitionBy("category").orderBy("row_id")
    rows = drop_duplicate_rows(valid_reviews(raw))
    return rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).drop("k")


def test_stream_equals_batch_with_repeats_and_restarts(spark, tmp_path, sf):
    raw = materialize(fx.raw_reviews(spark, sf), "raw")
    top = raw.agg(F.max("row_id")).first()[0] + 1
    raw = raw.unionByName(raw.where("row_id % 3 = 0").withColumn("row_id", F.col("row_id") + top))  # each third row comes again
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for lo, hi in ((0, 300), (300, top), (top, 3 * top)):
        raw.where((F.col("row_id") >= lo) & (F.col("row_id") < hi)).coalesce(2).write.mode("append").json(src)
        Q.start_quota_ingest(spark, src, out, state, 100).awaitTermination()
    expected = batch_result(raw, 100)
    got = Q.read_ingested(spark, out).select(*expected.columns)
    assert got.count() == expected.count() > 100 and got.exceptAll(expected).isEmpty()
    assert got.groupBy("category").count().agg(F.max("count")).first()[0] == 100


def test_a_batch_that_runs_again_takes_the_same_rows(spark, tmp_path, sf):
    raw = materialize(fx.raw_reviews(spark, sf), "raw")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    parts = [raw.where("row_id < 400"), raw.where("row_id >= 400")]
    for number, part in ((0, parts[0]), (1, parts[1]), (1, parts[1]), (0, parts[0])):
        Q.take_batch(part, number, out, state, 60)
    got = Q.read_ingested(spark, out)
    expected = batch_result(raw, 60)
    assert got.select(*expected.columns).exceptAll(expected).isEmpty() and got.count() == expected.count()
    Q.take_batch(raw.limit(0), 2, out, state, 60)
    assert Q.read_ingested(spark, out).count() == expected.count()


def test_staged_files_are_compressed_and_bounded(spark, sf, monkeypatch, tmp_path):
    from reviewsift.catalog import ingest
    monkeypatch.setattr(ingest, "scratch_path", lambda _, name: str(tmp_path / name))
    assert ingest.stream_quota(spark, sf).count() > 0
    staged = [p.name for p in (tmp_path / "quota_in").iterdir() if p.name.startswith("part-")]
    assert staged and all(name.endswith(".json.gz") for name in staged)
