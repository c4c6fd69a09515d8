"""WARC archives: exact round trips, with magic and whole records inside payloads."""

import base64
import glob
import hashlib
import random

import pytest

from reviewsift.llm import warc

FAKE = ("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 43\r\n\r\n"
        "HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def pages_of(n):
    rng = random.Random(5)
    bits = ["WARC/1.0\r\n", "\r\n\r\n", "é", "x" * 30, "\r\n", FAKE, "WARC/1.0", "WARC", "\r", "Content-Length: 5\r\n"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
        k = rng.random()
        rows.append((i, None if k < 0.1 else f"http://x/{i}/WARC/1.0\r\n<a>", None if k < 0.05 else "copy" + FAKE if k > 0.8 else text))
    return rows


def wanted(rows, least=0):
    first = {}
    for i, _, t in rows:
        if i is not None and len((t or "").encode()) >= least:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, _, t in rows:
        body = (t or "").encode()
        again = i is not None and len(body) >= least and i > first[t or ""]
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response",
                    first[t or ""] if again else None, b"" if again else body))
    return sorted(out, key=str)


def collected(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload))
                   for r in df.collect()), key=str)


SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize("stretch", [64, 1000, warc.STRETCH])
def test_round_trip_over_many_splits(spark, small_splits, tmp_path, stretch):
    rows = pages_of(60)
    path = f"{tmp_path}/archive"
    warc.write_archive(spark.createDataFrame(rows, SCHEMA).coalesce(2), path)
    assert collected(warc.read_archive(spark, path, stretch)) == wanted(rows)


def test_splits_of_another_size_when_the_rows_are_read(spark, small_splits, tmp_path):
    rows = pages_of(60)
    path = f"{tmp_path}/archive"
    warc.write_archive(spark.createDataFrame(rows, SCHEMA).coalesce(2), path)
    records = warc.read_archive(spark, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")  # as if executors had come or gone
    assert collected(records) == wanted(rows)


def test_edges(spark):
    rows = [(4, "u", "same"), (2, None, "same"), (2, "v", "same"), (None, "w", "same"), (7, "x", None), (8, "y", ""), (9, "z", "é" * 200_000),
            (-3, "neg", "minus")]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], SCHEMA + ", digest string, id int")
    assert collected(warc.archive_round_trip(df)) == wanted(rows)
    assert collected(warc.archive_round_trip(df, least=5)) == wanted(rows, least=5)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_a_broken_chain_is_an_error(spark, tmp_path):
    path = f"{tmp_path}/archive"
    warc.write_archive(spark.createDataFrame(pages_of(3), SCHEMA).coalesce(1), path)
    (name,) = [f for f in glob.glob(f"{path}/part-*")]
    data = open(name, "rb").read()
    torn = tmp_path / "torn"
    torn.mkdir()
    (torn / "a.warc").write_bytes(data[:-9])
    with pytest.raises(ValueError, match="broken chain"):
        warc.read_archive(spark, str(torn))


def test_base32(spark):
    values = ["", "a", "é\r\n"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(warc.base32_sha1(warc.F.col("v"))).collect()
    assert [r[0] for r in got] == [base64.b32encode(hashlib.sha1(v.encode()).digest()).decode() for v in values]
