"""Helpers shared by the operators of this package."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A task's Python worker holds about this many bytes of text at a time.
CHUNK_BYTES = 1 << 20

#: sha256 of no spans, no items.
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of up to so many narrow rows are broadcast, larger ones are joined by a shuffle; both give the same rows.
BROADCAST_ROWS = 500_000


def bounded(stored: DataFrame) -> DataFrame:
    """``stored`` (a stored table of narrow rows), to be broadcast if its counted rows are few enough."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def ascii_lower(text: Column) -> Column:
    """Only A-Z change; ``lower`` folds other letters too, so it serves texts that have none."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


def chunks(batches: Iterable[pa.Array], size: int = CHUNK_BYTES) -> Iterator[tuple[list, bool]]:
    """Pieces of Arrow batches as Python lists, each of about ``size`` bytes (or one longer value).

    The flag tells that a batch ends with this piece.
    """
    for batch in batches:
        n = len(batch)
        if n == 0:
            yield [], True
            continue
        step = max(1, int(n * size / max(1, batch.nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step).to_pylist(), at + step >= n


def per_value(batches: Iterable[pa.Array], kind: pa.DataType, work) -> Iterator[pa.Array]:
    """Apply ``work`` (list of values -> list of results) piece by piece; one array per batch."""
    done: list[pa.Array] = []
    for values, last in chunks(batches):
        done.append(pa.array(work(values), kind))
        if last:
            yield pa.concat_arrays(done)
            done = []


def row_key(text: Column) -> Column:
    """Tells rows of one document id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Null-safe equality of the named columns."""
    cond = F.lit(True)
    for n in names:
        cond = cond & a[n].eqNullSafe(b[n])
    return cond
