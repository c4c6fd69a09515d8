"""CSV records cut by chunks against a single-task reader."""

import csv
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewsift.sources import csv_records as R
from reviewsift.sources import readers


@pytest.fixture
def chunks(spark):
    """Files are read in chunks of about this many bytes."""
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield of
    for c, v in before.items():
        spark.conf.set(c, v)


def test_line_ends():
    ends = R.line_ends()
    for line, want in {
        "": (False, True), "a,b": (False, True), '"': (True, False), '""': (False, True), '"a': (True, False),
        'a","b': (True, True), '5" pipe,"x': (True, True), '"a""': (True, False), '"a"",b"': (False, False),
        'x"': (False, False), 'x",': (False, False), 'x""y': (False, True), '"a" b,"': (True, True),
        ',,"': (True, False), '"a","b"': (False, False),
    }.items():
        assert ends(line) == want, line


def test_line_ends_are_those_of_a_reader():
    rng = random.Random(1)
    ends = R.line_ends()
    for _ in range(3000):
        line = "".join(rng.choice('a",') for _ in range(rng.randrange(9)))
        state, i = "field", 0  # a plain state machine, outside quotes at first
        for c in line:
            if state == "field":
                state = "quoted" if c == '"' else "field" if c == "," else "bare"
            elif state == "bare":
                state = "field" if c == "," else "bare"
            elif state == "quoted":
                state = "closing" if c == '"' else "quoted"
            else:
                state = "quoted" if c == '"' else "field" if c == "," else "bare"
        assert ends(line)[0] == (state == "quoted"), line
        assert ends("\x01" + line)[0] == ends('"' + '"' + "," + "b" + line)[0]
        assert ends(line)[1] == ends('"' + line)[0], line


def gnarly(rng, n):
    """Rows with quotes, separators and line breaks, some over many lines."""
    piece = lambda: rng.choice(["word", '"', ",", "\n", " ", "é漢", '""', "\n\n", "x" * 30])
    return [[str(i), *("".join(piece() for _ in range(rng.randrange(12))) for _ in range(3))] for i in range(n)]


@pytest.mark.parametrize("size", [1000, 1 << 20])
def test_rows_equal_the_written_ones(spark, tmp_path, chunks, size):
    rng = random.Random(size)
    rows = gnarly(rng, 300) + [["300", "tail\n" * 40, "", "end"]]
    (tmp_path / "in").mkdir()
    for part, end in (("a.csv", "\n"), ("b.csv", "\r\n")):
        out = io.StringIO()
        w = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL)
        w.writerow(["row_id", "p", "q", "s"])
        w.writerows(rows[::2] if part == "a.csv" else rows[1::2])
        (tmp_path / "in" / part).write_bytes(out.getvalue().encode())
    schema = spark.createDataFrame([], "row_id long, p string, q string, s string").schema
    chunks(size)
    path = str(tmp_path / "in")
    records = R.csv_records(spark, path)
    assert records.select("file", "block").distinct().count() > (20 if size < 5000 else 1)
    got = sorted((r.row_id, r.p, r.q, r.s) for r in R.read_records(spark, path, schema, null_token="none").collect())
    assert got == sorted((int(a), b, c, d) for a, b, c, d in rows)
    single = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', nullValue="none")
    assert got == sorted((r.row_id, r.p, r.q, r.s) for r in single.collect())


def test_a_file_is_read_by_many_tasks(spark, tmp_path, chunks):
    body = "row_id,text\n" + "".join(f'{i},"line one\nline {i}"\n' for i in range(2000))
    (tmp_path / "one.csv").write_text(body)
    chunks(4000)
    plan = spark.read.text(str(tmp_path / "one.csv"))
    assert plan.rdd.getNumPartitions() >= len(body) // 4200
    schema = spark.createDataFrame([], "row_id long, text string").schema
    got = readers.read_csv(spark, str(tmp_path / "one.csv"), schema)
    assert got.agg(F.count("*"), F.sum("row_id")).first()[:] == (2000, 1999000)
    assert got.where("text <> 'line one\nline ' || row_id").isEmpty()


def test_odd_files(spark, tmp_path):
    folder = tmp_path / "odd"
    folder.mkdir()
    (folder / "empty.csv").write_text("")
    (folder / "blank.csv").write_text("\n\n")
    (folder / "header.csv").write_text("a,b\n")
    (folder / "bare.csv").write_text('a,b\n5" pipe,x\n\n"open,1\nstill 2\n')
    schema = spark.createDataFrame([], "a string, b string").schema
    got = {(r.a, r.b) for r in R.read_records(spark, str(folder), schema).collect()}
    assert ('5" pipe', "x") in got and len(got) == 2


def jobs_of(spark, work):
    tracker, group = spark.sparkContext.statusTracker(), f"g{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    work()
    found = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "rest")
    return found


@pytest.mark.parametrize("suffix", ["csv", "parquet"])
def test_jobs_do_not_grow_with_files(spark, tmp_path, suffix):
    counts = []
    for n in (3, 60):
        folder = tmp_path / f"{suffix}{n}"
        folder.mkdir()
        if suffix == "csv":
            for i in range(n):
                names = ["k", "v"] if i % 2 else ["v", "k", f"extra{i % 3}"]
                (folder / f"{i}.csv").write_text(",".join(names) + "\n" + ",".join(f"{c}{i}" for c in names) + "\n")
        else:
            one = spark.range(1).withColumn("k", F.lit("k")).coalesce(1)
            one.write.parquet(str(tmp_path / f"t{n}"))
            data = next((tmp_path / f"t{n}").glob("part-*")).read_bytes()
            for i in range(n):
                (folder / f"{i}.parquet").write_bytes(data)

        def work():
            table = readers.combine_folder(spark, str(folder), source_in_key=True)
            assert table.count() == n
            if suffix == "csv":
                assert {"k", "v", "source_file"} <= set(table.columns)
                assert table.where("v is null or k is null or substr(v, 2) <> substr(k, 2)").isEmpty()

        counts.append(jobs_of(spark, work))
    assert counts[1] <= counts[0] + 2


def test_columns_of_several_types_and_bad_files(spark, tmp_path):
    folder = tmp_path / "mixed"
    for i, kind in enumerate(("int", "string")):
        spark.range(2).select(F.col("id").cast(kind).alias("x")).coalesce(1).write.parquet(str(folder / f"{i}.parquet"))
    got = readers.combine_folder(spark, str(folder))
    assert sorted(str(r.x) for r in got.collect()) == ["0", "1"]


def test_lines_of_a_record_are_joined_within_a_task():
    rows = [("f", 0, 1, 0, 1, 'a,"b', 0, 1), ("f", 0, 1, 0, 2, "", 1, 1), ("f", 0, 1, 0, 3, 'c"', 1, 0),
            ("f", 0, 5, 0, 5, '"d', 0, 1), ("f", 0, 5, 9, 0, 'e"', 1, 0), ("f", 9, 7, 9, 8, 'h"', 1, 0), ("f", 9, 7, 9, 7, '"g', 0, 1)]
    batches = [pa.Table.from_pylist([dict(zip(R._PIECES.names, r)) for r in part], schema=R._PIECES).to_batches()[0]
               for part in (rows[:2], rows[2:])]
    got = [tuple(r.values()) for b in R._joined_lines(iter(batches)) for r in b.to_pylist()]
    assert got == [("f", 0, 1, 0, 1, 'a,"b\n\nc"', 0, 0), *rows[3:]]  # other chunks and orders are left to the grouping
    assert not any(b.num_rows for b in R._joined_lines(iter([])))


def test_lines_are_noted_as_by_a_plain_reader_however_batches_are_cut():
    rng, ends = random.Random(4), R.line_ends()
    text = ["".join(rng.choice('a",') for _ in range(rng.randrange(5))) for _ in range(400)]
    rows = [(v, "fg"[i > 150], 100 * (i > 260)) for i, v in enumerate(text)]
    want, chunk = [], None
    for value, file, block in rows:
        if (file, block) != chunk:
            chunk, line, state, begun = (file, block), 0, [0, 1], [-1, -1]
        now = [int(ends(value)[s]) for s in state]
        begun = [line if s == 0 else b for s, b in zip(state, begun)]
        want.append((file, block, line, value, *state, *now, *begun))
        state, line = now, line + 1
    for size in (1, 7, 400):
        cut = [pa.RecordBatch.from_pydict(dict(zip("vfb", map(list, zip(*rows[i:i + size]))))) for i in range(0, 400, size)]
        assert [tuple(r.values()) for b in R._read_chunks(",")(iter(cut)) for r in b.to_pylist()] == want


def test_no_line_without_a_quote_is_looked_at(monkeypatch):
    seen = []
    monkeypatch.setattr(R, "line_ends", lambda sep: lambda v: seen.append(v) or (True, False))
    batch = pa.RecordBatch.from_pydict({"v": ["a", '"b', "c", 'd"', "e"], "f": ["f"] * 5, "b": [0] * 5})
    got = [r for b in R._read_chunks(",")(iter([batch])) for r in b.to_pylist()]
    assert seen == ['"b', 'd"'] and [r["start0"] for r in got] == [0, 0, 1, 1, 0]


def test_a_return_goes_only_at_the_end_of_a_record(spark):
    values = ["a\r", "a", "\r", "a\rb", "a\r\n", "a\r\r", "\ra\x85", "a\r\u2028", "a\n"]
    got = spark.createDataFrame([(v,) for v in values], "record string").select(
        "record", R._without_return("record").alias("a"), F.regexp_replace("record", "\r$", "").alias("b"))
    assert all(r.a == r.b for r in got.collect()) and got.where("a <> record").count() == 4
