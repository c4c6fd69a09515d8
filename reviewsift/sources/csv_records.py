"""CSV records with quoted line breaks, cut by as many tasks as a file has chunks.

Whether a line begins a record depends on the quotes of all lines before it. Each task reads its chunk of a file line
by line under both assumptions, that the chunk begins outside quotes and inside, and notes for both where records begin
and in which state the chunk ends. One row per chunk is then folded along its file, which settles every
chunk's assumption. Records of one line are ready where they are; lines of a longer record are joined by the task that
reads them one after the other, and only pieces of records that lie in several tasks or chunks are grouped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewsift.operators.ordering import small
from reviewsift.session import materialize

_LINES = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("line", pa.int64()), ("value", pa.string()),
    *((f"{name}{k}", pa.int64()) for name in ("start", "end", "begun") for k in (0, 1))])
_LINES_DDL = ("file string, block long, line long, value string, start0 long, start1 long, end0 long, end1 long, "
              "begun0 long, begun1 long")

_PIECES = pa.schema([
    ("file", pa.string()), ("at_block", pa.int64()), ("at_line", pa.int64()), ("block", pa.int64()), ("line", pa.int64()),
    ("value", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_PIECES_DDL = "file string, at_block long, at_line long, block long, line long, value string, start long, end long"


def line_ends(sep: str = ",") -> Callable[[str], tuple[bool, bool]]:
    """Tells of a line whether a quoted field is open behind it: if none was before it, and if one was.

    A quote opens a field only at its beginning, and two quotes inside a quoted field are one; what follows a closing
    quote belongs to the field up to the separator.
    """
    s = re.escape(sep)
    quoted = r'"(?:[^"]|"")*+'
    opened = re.compile(rf'(?:(?:[^"{s}][^{s}]*+|{quoted}"[^{s}]*+)?+{s})*+{quoted}\Z', re.DOTALL)
    rest, tail = re.compile(r'(?:[^"]|"")*+', re.DOTALL), re.compile(rf'"[^{s}]*+', re.DOTALL)

    def ends(line: str) -> tuple[bool, bool]:
        if '"' not in line:
            return False, True
        at = rest.match(line).end()
        if at == len(line):
            return opened.match(line) is not None, True
        at = tail.match(line, at).end()
        return opened.match(line) is not None, at < len(line) and opened.match(line, at + 1) is not None

    return ends


def _breaks(batch: pa.RecordBatch, columns: list[int]) -> np.ndarray:
    """Whether a row differs from the one before it in one of the columns (false for the first)."""
    out = np.zeros(batch.num_rows, bool)
    for c in columns:
        column = batch.column(c)
        if not pa.types.is_integer(column.type):
            column = column.dictionary_encode().indices
        values = column.to_numpy(zero_copy_only=False)
        out[1:] |= values[1:] != values[:-1]
    return out


def _read_chunks(sep: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, chunk = line_ends(sep), None
        for batch in batches:
            quoted = pc.match_substring(batch.column(0), '"').to_numpy(zero_copy_only=False)
            if not len(quoted):
                continue
            # only lines with a quote change the state
            after = iter([ends(v) for v in batch.column(0).filter(pa.array(quoted)).to_pylist()])
            cuts, parts = np.flatnonzero(_breaks(batch, [1, 2])), []
            for low, high in zip([0, *cuts], [*cuts, len(quoted)]):
                if (at := (batch.column(1)[low].as_py(), batch.column(2)[low].as_py())) != chunk:
                    chunk, line, state, begun = at, 0, (0, 1), [-1, -1]
                here, numbers = quoted[low:high], np.arange(line, line + high - low)
                states = [state]
                for _ in range(here.sum()):
                    a = next(after)
                    states.append((int(a[states[-1][0]]), int(a[states[-1][1]])))
                of, past = np.array(states), np.cumsum(here)
                start, end = of[past - here], of[past]
                first = [np.maximum(np.maximum.accumulate(np.where(start[:, k] == 0, numbers, -1)), begun[k]) for k in (0, 1)]
                parts.append((numbers, start[:, 0], start[:, 1], end[:, 0], end[:, 1], *first))
                line, state, begun = line + high - low, states[-1], [int(f[-1]) for f in first]
            numbers, *rest = (np.concatenate(c) for c in zip(*parts))
            columns = [batch.column(1), batch.column(2), numbers, batch.column(0), *rest]
            yield pa.RecordBatch.from_arrays([
                c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _LINES)], schema=_LINES)

    return read


def _joined_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a record that come one after the other as one piece, with the states before and after it."""
    held: list[pa.RecordBatch] = []  # the lines of the last piece so far

    def begins(batch: pa.RecordBatch) -> np.ndarray:
        line = batch.column(4).to_numpy()
        return np.flatnonzero(_breaks(batch, [0, 1, 2, 3]) | np.r_[True, line[1:] != line[:-1] + 1])

    def pieces(lines: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.concat_batches(lines)
        at = begins(batch)
        values = pa.ListArray.from_arrays(pa.array(np.r_[at, batch.num_rows], pa.int32()), batch.column(5))
        first, last = batch.take(pa.array(at)), batch.column(7).take(pa.array(np.r_[at[1:], batch.num_rows] - 1))
        return pa.RecordBatch.from_arrays([
            *first.columns[:5], pc.binary_join(values, "\n"), first.column(6), last], schema=_PIECES)

    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, _PIECES)], schema=_PIECES)
        at = begins(batch)
        if held and len(begins(pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]))) == 1:
            at = at[1:]
        if len(at):
            done = [*held, batch.slice(0, at[-1])]
            if any(b.num_rows for b in done):
                yield pieces(done)
            held = []
        held.append(batch.slice(at[-1] if len(at) else 0))
    if held:
        yield pieces(held)


def _fold(chunks: pd.DataFrame) -> pd.DataFrame:
    """State and latest record before each chunk of one file (a row per chunk)."""
    state, record, out = 0, (0, 0), []
    for c in chunks.sort_values("block").itertuples():
        out.append((c.file, c.block, state, *record))
        begun = (c.begun0, c.begun1)[state]
        record = (c.block, begun) if begun >= 0 else record
        state = (c.end0, c.end1)[state]
    return pd.DataFrame(out, columns=["file", "block", "state", "last_block", "last_line"])


def csv_records(spark: SparkSession, path: str, sep: str = ",", **options: str) -> DataFrame:
    """``(file, block, line, record)`` of the CSV files of ``path``: each record's text and where it begins.

    Lines end with ``\\n`` or ``\\r\\n``; blank records are left out. A quote that is never closed makes the rest of its
    file one record. ``options`` go to Spark's text reader. A compressed file is one chunk.
    """
    return _records(_placed_lines(spark, path, sep, **options))


def _placed_lines(spark: SparkSession, path: str, sep: str, **options: str) -> DataFrame:
    """Lines with the place where their record begins and the states before and after them, columns as ``_PIECES``."""
    lines = materialize(
        spark.read.options(**options).option("lineSep", "\n").text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        .mapInArrow(_read_chunks(sep), _LINES_DDL), "csv_lines")
    last = [F.max_by(c, "line").alias(c) for c in ("end0", "end1", "begun0", "begun1")]
    chunks = small(materialize(
        lines.groupBy("file", "block").agg(*last).groupBy("file").applyInPandas(
            _fold, "file string, block long, state long, last_block long, last_line long"), "csv_chunks"))
    of = lambda name: F.when(F.col("state") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    known = lines.join(chunks, ["file", "block"])
    inside = of("begun") >= 0
    return known.select(
        "file", F.when(inside, F.col("block")).otherwise(F.col("last_block")).alias("at_block"),
        F.when(inside, of("begun")).otherwise(F.col("last_line")).alias("at_line"),
        "block", "line", "value", of("start").alias("start"), of("end").alias("end"))


def _records(placed: DataFrame) -> DataFrame:
    whole = (F.col("start") == 0) & (F.col("end") == 0)
    pieces = placed.where(~whole).mapInArrow(_joined_lines, _PIECES_DDL)
    ready = placed.where(whole).unionByName(pieces.where(whole)).select("file", "block", "line", F.col("value").alias("record"))
    several = pieces.where(~whole).groupBy("file", "at_block", "at_line").agg(
        F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("parts")).select(
        "file", F.col("at_block").alias("block"), F.col("at_line").alias("line"),
        F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("record"))
    return ready.unionByName(several).withColumn("record", _without_return("record")).where("record <> ''")


def _without_return(record: str) -> Column:
    """The record without a carriage return at its end; others are not searched for one."""
    ended = reduce(Column.__or__, [F.col(record).endswith("\r" + end) for end in ("", "\n", "\x85", "\u2028", "\u2029")])
    return F.when(ended, F.regexp_replace(record, "\r$", "")).otherwise(F.col(record))


def first_records(records: DataFrame) -> DataFrame:
    """``(file, head_block, head_line, head)``: the header of each file. It begins in the first chunk."""
    order = F.struct("block", "line")
    return records.where("block = 0").groupBy("file").agg(
        F.min(order).alias("at"), F.min_by("record", order).alias("head")).select(
        "file", F.col("at.block").alias("head_block"), F.col("at.line").alias("head_line"), "head")


def _heads(lines: DataFrame) -> DataFrame:
    """``first_records`` of placed lines; only the lines of the first record that is not blank are joined."""
    begun = lines.where("at_block = 0")
    blank = (F.col("start") == 0) & (F.col("end") == 0) & F.col("value").isin("", "\r")
    # a row per file
    first = materialize(begun.where(~blank).groupBy("file").agg(F.min("at_line").alias("at_line")), "csv_first")
    return first_records(_records(begun.join(small(first), ["file", "at_line"], "left_semi")))


def _body(records: DataFrame, heads: DataFrame) -> DataFrame:
    return records.join(heads, "file").where("not (block = head_block and line = head_line)")


def _parsed(record: str, schema: T.StructType, null_token: str = "", sep: str = ","):
    return F.from_csv(record, _ddl(schema), {
        "escape": '"', "nullValue": null_token, "sep": sep, "multiLine": "true", "maxCharsPerColumn": "-1"})


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def read_records(spark: SparkSession, path: str, schema: T.StructType, null_token: str = "", sep: str = ",") -> DataFrame:
    """The rows of CSV files with a header line, typed by ``schema`` column by column."""
    lines = _placed_lines(spark, path, sep)
    records = _records(lines)
    heads = small(materialize(_heads(lines), "csv_heads"))
    return _body(records, heads).select(_parsed("record", schema, null_token, sep).alias("_r")).select("_r.*")


def read_by_header(spark: SparkSession, path: str, sep: str = ",", place: str | None = None, **options: str) -> DataFrame:
    """The rows of CSV files whose headers differ: strings by column name, missing ones null, with ``file`` and, on
    request, the chunk and line where the record begins as ``place``.

    The headers are a table and the names an aggregate of it, so thousands of files take no more jobs than
    one. Columns come in the order of their first file.
    """
    lines = _placed_lines(spark, path, sep, **options)
    records = _records(lines)
    heads = materialize(_heads(lines), "csv_heads")
    seps = F.length("head") - F.length(F.replace("head", F.lit(sep)))
    width = (heads.agg(F.max(seps)).first()[0] or 0) + 1
    wide = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    fields = lambda c: F.array(*[c[f"c{i}"] for i in range(width)])
    heads = heads.withColumn("_h", _parsed("head", wide, sep=sep)).withColumn("names", fields(F.col("_h"))).drop("_h")
    heads = small(materialize(heads, "csv_names"))
    names = heads.select("file", F.posexplode("names").alias("at", "name")).where("name is not null").groupBy("name").agg(
        F.min(F.struct("file", "at")).alias("first")).orderBy("first").select("name").collect()  # the table's columns
    rows = _body(records, heads).withColumn("_r", _parsed("record", wide, sep=sep)).withColumn("_v", fields(F.col("_r")))
    value = lambda n: F.try_element_at(F.col("_v"), F.nullif(F.array_position("names", F.lit(n)), F.lit(0)).cast("int"))
    return rows.select(*[value(r.name).alias(r.name) for r in names], "file",
                       *([F.struct("block", "line").alias(place)] if place else []))
