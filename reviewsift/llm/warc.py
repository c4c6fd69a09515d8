"""WARC archives: written with Spark's text writer, read back by boundary-chain verification.

A record is text up to its length; records end with two line breaks, which is the writer's line separator.
The reader lets Spark split the files at the version line, wherever a split begins. Every piece is a
candidate record whose header gives the offset of its successor. Payloads may hold the version
line or whole records, so a candidate counts only if the chain from the start of its file reaches it:
chains are followed inside stretches of a file, and pointer jumping joins the stretches in a logarithmic
number of rounds. Only narrow rows are shuffled; texts are where a payload was cut by a false candidate.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewsift.llm.common import bounded
from reviewsift.session import materialize, scratch_path

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
ID_PREFIX = "urn:page:"
#: Bytes of a file whose candidates are chained in one task.
STRETCH = 4 << 20
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string or binary column; twenty bits are four digits."""
    digest = F.sha1(data.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record(kind: Column, page_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column) -> Column:
    """A WARC record without its closing line breaks. A revisit has the HTTP header only."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit(END))
    block = F.when(kind == "revisit", http).otherwise(F.concat(http, payload))
    name = lambda i: F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(i.cast("string"), F.lit("")), F.lit(">\r\n"))
    # no header line may end like the version line, so the address stands in brackets
    address = F.regexp_replace(url, r"[\x00-\x20<>\x7F]", "%20")
    return F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), name(page_id),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        F.when(url.isNull(), "").otherwise(F.concat(F.lit("WARC-Target-URI: <"), address, F.lit(">\r\n"))),
        F.lit("WARC-Payload-Digest: sha1:"), digest, F.lit("\r\n"),
        F.when(kind == "revisit", F.concat(
            F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(refers_to))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(END), block)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                  least: int = 0) -> None:
    """Write one record per row of ``pages`` to WARC files under ``path``.

    Of rows with equal payloads of at least ``least`` bytes, the smallest id is the response and the others
    revisit it. A null payload is empty, a null address is left out. Rows with a null id are responses that
    nothing refers to; rows that repeat the smallest id are responses. An empty table gives no record.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(body_col), F.lit("")).alias("body"),
    ).withColumn("digest", base32_sha1(F.col("body")))
    copies = materialize(
        rows.where((F.octet_length("body") >= least) & F.col("id").isNotNull())
        .groupBy(F.col("digest").alias("_digest")).agg(F.min("id").alias("first"), F.max("id").alias("_last"))
        .where("first < _last").drop("_last"), "copies")
    joined = rows.join(
        copies, (rows["digest"] == copies["_digest"]) & (F.octet_length("body") >= least), "left")
    kind = F.when(F.col("id") > F.col("first"), "revisit").otherwise("response")
    joined.select(record(kind, F.col("id"), F.col("url"), F.col("body"), F.col("digest"), F.col("first"))).write.option(
        "lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between version lines, with its place: file, split and running number.

    Stored once: another scan may be cut into other splits, as their size depends on the cores of the moment.
    """
    rows = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("n"), F.octet_length("value").cast("long").alias("size"),
        F.when(F.contains("value", F.lit(END)),
               F.octet_length(_header()) + len(END) + _field(_header(), "Content-Length").try_cast("long")
               + len(END)).alias("length"), "value")
    stored = scratch_path(spark, "pieces")
    rows.write.option("compression", "zstd").parquet(stored)
    return spark.read.schema(rows.schema).parquet(stored)


def _header(value: str = "value") -> Column:
    return F.substring_index(value, END, 1)


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def _candidates(pieces: DataFrame) -> DataFrame:
    """``(file, split, n, offset, size, next)``: each piece's start (of its version line) and, where it has
    a header with a length, the start of its successor. ``size`` is without the version line."""
    marks = pieces.drop("value")
    # a piece begins behind its version line; the piece before the first line of a file is what stands there
    width = F.col("size") + len(MAGIC)
    sums = marks.groupBy("file", "split").agg(F.sum(width).alias("_sum"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("file", "split", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("file", "split").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = marks.withColumn("_at", F.sum(width).over(inside) - width).join(starts, ["file", "split"])
    begin = F.col("_start") + F.col("_at")
    return placed.select(
        "file", "split", "n", (begin - len(MAGIC)).alias("offset"), "size", (begin + F.col("length")).alias("next"))


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """Where the chain of each candidate leaves its stretch."""
    rows = rows.sort_values("offset", ascending=False)
    after: dict[int, int] = {}
    for offset, following in zip(rows["offset"], rows["next"]):
        after[offset] = after.get(following, following)
    return pd.DataFrame({"file": rows["file"], "offset": rows["offset"], "exit": rows["offset"].map(after)})


def _walk(entries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a stretch on the chain from where it enters (one place, if any)."""
    rows = rows.sort_values("offset")
    kept, reached = [], set(entries["offset"])
    for offset, following in zip(rows["offset"], rows["next"]):
        kept.append(offset in reached)
        if kept[-1]:
            reached.add(following)
    return rows[kept][["file", "split", "n", "offset", "size", "next"]]


def _reachable(found: DataFrame, stretch: int) -> DataFrame:
    """Candidates on the chain from the start of their file. ``found`` is a stored table."""
    rows = found.where(F.col("next").isNotNull()).withColumn("part", F.expr(f"offset div {stretch}"))
    exits = materialize(
        rows.groupBy("file", "part").applyInPandas(_exits, "file string, offset long, exit long"), "exits")
    targets = exits.select("file", F.col("exit").alias("offset")).distinct()
    jump = materialize(exits.join(targets.unionByName(exits.where("offset = 0").select("file", "offset")).distinct(),
                                  ["file", "offset"], "left_semi"), "jumps")
    reached = materialize(jump.where("offset = 0").select("file", "offset"), "reached")
    size = reached.count()
    while True:  # every round doubles the stretches a jump crosses
        more = reached.join(jump, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        more = more.join(jump, ["file", "offset"], "left_semi")
        grown = materialize(reached.unionByName(more).distinct(), "reached")
        now = grown.count()
        if now == size:
            break
        onward = jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("_exit"))
        jump = materialize(
            jump.join(onward, ["file", "exit"], "left")
            .select("file", "offset", F.coalesce("_exit", "exit").alias("exit")), "jumps")
        reached, size = grown, now
    entries = reached.withColumn("part", F.expr(f"offset div {stretch}"))
    return entries.groupBy("file", "part").cogroup(rows.groupBy("file", "part")).applyInPandas(
        _walk, "file string, split long, n long, offset long, size long, next long")


def _parsed(rows: DataFrame) -> DataFrame:
    """Fields of ``value``, a record behind its version line."""
    head, data = F.col("_head"), F.col("value").cast("binary")
    length = _field(head, "Content-Length").cast("long")
    at = F.octet_length(head) + len(END)
    block = F.substring(data, at + 1, length.cast("int")).cast("string")
    http = F.substring_index(block, END, 1)
    body = F.substring(block.cast("binary"), F.octet_length(http) + len(END) + 1, length.cast("int"))
    page = lambda name: F.regexp_extract(_field(head, name), f"{ID_PREFIX}(-?[0-9]+)", 1).try_cast("long")
    return rows.withColumn("_head", _header()).select(
        "file", _field(head, "WARC-Type").alias("record_type"), page("WARC-Record-ID").alias("page_id"),
        F.regexp_extract(_field(head, "WARC-Target-URI"), "^<(.*)>$", 1).alias("url"),
        F.regexp_replace(_field(head, "WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        F.coalesce(_field(http, "Content-Length").try_cast("long"), F.octet_length(body).cast("long"))
        .alias("payload_bytes"),
        page("WARC-Refers-To").alias("refers_to"), body.alias("payload"))


def read_archive(spark: SparkSession, path: str, stretch: int = STRETCH) -> DataFrame:
    """One row per record of the WARC files under ``path``: file, record_type, page_id, url, payload_digest,
    payload_bytes, refers_to, payload (binary; empty for a revisit, whose payload_bytes is its response's).

    Raises where the chain of a file does not end at the end of the file.
    """
    pieces = _pieces(spark, path)
    found = materialize(_candidates(pieces), "candidates")
    true = materialize(_reachable(found, stretch), "records")
    ends = found.groupBy("file").agg(F.max(F.col("offset") + len(MAGIC) + F.col("size")).alias("end"))
    torn = ends.where("end > 0").join(
        true.groupBy("file").agg(F.max("next").alias("last")), "file", "left").where("last IS NULL OR last <> end")
    if (bad := torn.first()) is not None:
        raise ValueError(f"broken chain in {bad.file}: it ends at {bad.last}, the file at {bad.end}")
    whole = (F.col("next") - F.col("offset") - len(MAGIC)) == F.col("size")
    place = ["file", "split", "n"]
    # all pieces that are not a whole record, a few: those of records that hold the version line, and the
    # nothing before the first line of a file
    cut = bounded(materialize(
        found.join(true.where(whole), place, "left_anti").select(*place, "offset"), "cut"))
    plain = _parsed(pieces.join(cut, place, "left_anti").select("file", "value"))
    owners = true.where(~whole).select(
        "file", F.col("offset").alias("owner"), "next",
        F.explode(F.sequence(F.expr(f"offset div {stretch}"), F.expr(f"(next - 1) div {stretch}"))).alias("part"))
    fragments = (
        cut.withColumn("part", F.expr(f"offset div {stretch}")).join(owners, ["file", "part"])
        .where("owner <= offset AND offset < next").select(*place, "offset", "owner")
    )
    joined = (
        pieces.select(*place, "value").join(bounded(materialize(fragments, "fragments")), place)
        .groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("_parts"))
        .select("file", F.array_join("_parts.value", MAGIC).alias("value"))
    )
    return plain.unionByName(_parsed(joined))


def archive_round_trip(pages: DataFrame, least: int = 0, **columns: str) -> DataFrame:
    """Write ``pages`` to an archive in the session's shared folder and read its records back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path, least=least, **columns)
    return read_archive(pages.sparkSession, path)
