import pytest
from pyspark.sql import functions as F

from reviewsift import fixtures as fx
from reviewsift.catalog import ingest
from reviewsift.operators import ordering, rating_model as M
from reviewsift.operators.validate import valid_reviews
from reviewsift.sources import readers, sinks
from reviewsift.streaming.ingest import start_validated_ingest


def test_categories(spark, tmp_path, sf):
    path = str(tmp_path / "raw")
    fx.raw_reviews(spark, sf).write.partitionBy("category").parquet(path)
    with pytest.raises(ValueError):
        readers.read_reviews(spark, path, None)
    with pytest.warns(UserWarning):
        df = readers.read_reviews(spark, path, "en", num_samples=7)
    assert df.count() == 7
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(category" in plan
    with pytest.raises(ValueError):
        readers.check_categories(spark, ["Books", "Bookz"])


def test_sample_formats(spark, tmp_path, sf):
    raw = fx.raw_reviews(spark, sf)
    with pytest.raises(ValueError):
        sinks.save_sample(raw, str(tmp_path / "x"), fmt="xml")
    sinks.save_sample(raw, str(tmp_path / "csv"), 20, "csv")
    back = spark.read.csv(str(tmp_path / "csv"), header=True, multiLine=True, escape='"')
    assert back.count() == 20 and back.columns == raw.columns


def test_csv_null_tokens(spark, tmp_path):
    df = spark.createDataFrame([(1, "None"), (2, "a\nb \"q\""), (3, "")], "row_id long, title string")
    sinks.csv_writer(df).csv(str(tmp_path / "t"))
    keep = readers.read_csv(spark, str(tmp_path / "t"), df.schema)
    assert {r.title for r in keep.collect()} >= {"None", 'a\nb "q"'}
    assert readers.read_csv(spark, str(tmp_path / "t"), df.schema, null_token="None").where("row_id = 1").count() == 0


def test_combine_folder(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string")
    folder = tmp_path / "in"
    folder.mkdir()
    for name, df in (("a", a), ("b", a), ("c", a.withColumn("extra", F.lit(1)))):
        df.coalesce(1).write.parquet(str(tmp_path / name))
        part = next((tmp_path / name).glob("part-*.parquet"))
        (folder / f"{name}.parquet").write_bytes(part.read_bytes())
    got = readers.combine_folder(spark, str(folder))
    assert got.count() == 4 and {r.source_file for r in got.collect()} == {"a.parquet", "c.parquet"}
    assert readers.combine_folder(spark, str(folder), source_in_key=True).count() == 6
    assert readers.combine_folder(spark, str(folder), use_parquet=False) is None
    (folder / "bad.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        readers.combine_folder(spark, str(folder))
    with pytest.warns(UserWarning, match="bad.parquet"):
        assert readers.combine_folder(spark, str(folder), skip_unreadable=True).count() == 4


def test_combine_csv_files_by_column_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text('y,x,z\n20,10,"3\n0"\n2,1,\n')
    got = readers.combine_folder(spark, str(tmp_path))
    assert sorted(map(str, (tuple(r[c] for c in ("x", "y", "z", "source_file")) for r in got.collect()))) == sorted(map(str, [
        ("1", "2", None, "a.csv"), ("10", "20", "3\n0", "b.csv")]))


def test_split_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, "A & B", "train"), (2, "A & B", "test")], "row_id long, category string, split string")
    sinks.write_splits(df, str(tmp_path / "s"), csv_too=True)
    assert {p.name for p in (tmp_path / "s" / "parquet").glob("split=*")} == {"split=train", "split=test"}
    assert (tmp_path / "s" / "csv" / "split=test" / "category_name=a_and_b").is_dir()


def test_files_of_a_split_are_bounded_and_runs_repeat(spark, tmp_path):
    df = spark.range(0, 60_000, 1, 24).select(
        F.col("id").alias("row_id"), F.concat(F.lit("C"), F.when(F.col("id") < 40_000, 0).otherwise(F.col("id") % 5)).alias("category"),
        F.when(F.col("id") % 7 == 0, "test").otherwise("train").alias("split"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
        sinks.write_splits(df, str(tmp_path / "s"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    files = {p: sorted(p.glob("part-*")) for p in (tmp_path / "s" / "parquet").glob("split=*/category_name=*")}
    assert len(files) == 10 and all(f.stat().st_size < 6_000_000 for fs in files.values() for f in fs)
    counts = {f"{p.parent.name}/{p.name}": len(fs) for p, fs in files.items()}
    assert counts["split=train/category_name=c0"] > 1 and sum(counts.values()) < 40  # not a file per task and partition
    again = df.where("split = 'test'").withColumn("row_id", F.col("row_id") + 1)
    for _ in range(2):  # replaces its own partitions only
        sinks.write_splits(again, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s" / "parquet"))
    assert back.count() == 60_000 and back.where("split = 'test'").agg(F.min("row_id")).first()[0] == 1
    assert back.where("split = 'train'").agg(F.sum("row_id")).first()[0] == df.where("split = 'train'").agg(F.sum("row_id")).first()[0]


def test_texts_are_cut_for_the_model(spark):
    from reviewsift.functions.text import first_pieces, piece_count
    rows = [("a b, c",), ("",), (None,), ("  x--y  z ",), ("one\ntwo three!",), ("word " * 300_000,), ("ü_1 漢字 é",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(first_pieces("t", 3)).collect()]
    assert got[:5] == ["a b,", "", None, "  x--", "one\ntwo three"] and got[6] == "ü_1 漢字 é"
    long = df.where("length(t) > 1000").select(first_pieces("t", 510).alias("t"))
    assert long.select(piece_count("t")).first()[0] == 512
    scored = M.score_with(df.where("t is not null").selectExpr("t as review_data", "1.0 as rating"),
                          lambda: lambda texts: [float(len(t)) for t in texts], max_tokens=5)
    assert scored.agg(F.max("predicted_rating")).first()[0] == len("word word word")


def test_anomaly_and_metric_sinks(spark, tmp_path):
    for _ in range(2):
        sinks.write_anomalies(spark.range(2), str(tmp_path / "out"), 0.6, 12, None)
    back = spark.read.parquet(str(tmp_path / "out_eps_0.6_min_samples_12_batch_size_None"))
    assert tuple(back.select("eps", "min_samples", "batch_size").first()) == (0.6, 12, None)
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0)], "section string, key string, value double")
    sinks.write_metrics(rows, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().metrics.asDict() == {"x": 1.0, "y": 2.0}


def test_stream_equals_batch_and_restarts(spark, tmp_path, sf):
    raw = fx.raw_reviews(spark, sf)
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    half = F.col("row_id") < 500
    for part in (raw.where(half), raw.where(~half)):
        part.repartition(3).write.mode("append").json(src)
        start_validated_ingest(spark, src, out, state).awaitTermination()
    expected = valid_reviews(raw)
    got = spark.read.schema(expected.schema).parquet(out)
    assert got.count() == expected.count() and got.exceptAll(expected).isEmpty()


def test_rating_model_learns_and_resumes(spark):
    rows = [(i, "great lovely" if i % 2 else "awful broken", 5.0 if i % 2 else 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, review_data string, rating double")
    model = M.train_rating_model(df, buckets=256)
    assert M.evaluate_rating_model(model, df).first().r2 > 0.8
    half = df.withColumn("predicted_rating", F.when(F.col("row_id") < 50, F.lit(9.0)))
    half = half.withColumn("rating_diff", F.col("predicted_rating") - F.col("rating"))
    done = M.score_unscored(half, lambda d: M.score_ratings(d, model)).collect()
    assert len(done) == 200 and all((r.predicted_rating == 9.0) == (r.row_id < 50) for r in done)
    external = M.score_with(df, lambda: lambda texts: [float(len(t)) for t in texts])
    assert external.where(F.col("predicted_rating") != F.length("review_data")).isEmpty()


@pytest.mark.parametrize("few", [1, 50_000])
def test_repeats_across_files_leave_without_a_shuffle_of_the_rows(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(ordering, "BROADCAST_ROWS", few)
    rows = spark.range(60).select((F.col("id") % 40).alias("n"), F.when(F.col("id") % 2 == 0, F.col("id") % 8).alias("m"))
    rows.coalesce(2).write.parquet(str(tmp_path / "all" / "a.parquet"))
    rows.select("m", "n").coalesce(1).write.parquet(str(tmp_path / "all" / "b.parquet"))
    rows.select("n").coalesce(1).write.parquet(str(tmp_path / "all" / "c.parquet"))
    got = readers.combine_folder(spark, str(tmp_path / "all"))
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(r.n, r.m): "a.parquet" for r in rows.collect()}
    want |= {(n, None): "c.parquet" for n in range(40) if (n, None) not in want}
    assert got.count() == len(want) and {(r.n, r.m): r.source_file for r in got.collect()} == want


def test_stream_validate_stages_and_stores_compressed_files(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "scratch_path", lambda _, name: str(tmp_path / name))
    got = ingest.stream_validate(spark, sf)
    fx.raw_reviews(spark, sf).write.json(str(tmp_path / "plain"))
    size = lambda name: sum(f.stat().st_size for f in (tmp_path / name).glob("part-*"))
    assert 2 * size("stream_in") < size("plain")
    assert all(".zstd." in f.name for f in (tmp_path / "stream_out").glob("part-*"))
    assert got.count() == valid_reviews(fx.raw_reviews(spark, sf)).count()
