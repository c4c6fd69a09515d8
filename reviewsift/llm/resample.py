"""Target-distribution importance resampling over hashed word features.

A batch's texts are joined with a separator no word has, one regex pass over the joined bytes finds the
words of all of them, and ``searchsorted`` on the texts' offsets tells whose they are; runs of words that
reach into another text are masked before ``bincount``. The features of both tables are counted in a
fixed number of buckets. A text's weight is the mean logarithm of how much likelier its features are in the
target table; Gumbel noise from a digest of the id turns the highest scores into a draw without
replacement, which every run repeats.

Only the bucket counts (a fixed number) meet on the driver; ranks come from a range partitioning.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsift.llm.common import chunks, per_value
from reviewsift.operators.ordering import with_position
from reviewsift.session import materialize

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Of lower-cased UTF-8 bytes: ASCII letters and digits, and every other character.
_WORD, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
_SEPARATOR = b"\x00"
#: Bytes the regex goes through before their words are counted, so a text of any length needs bounded memory.
SLAB = 1 << 20
#: Buckets of words that a Python worker keeps.
CACHED = 200_000


class _Buckets(dict):
    """Bucket of each feature; starts again where it grew too large."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def batch_features(texts: list[bytes | None], least: int, most: int, bucket_of: _Buckets,
                   slab: int = SLAB) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(owners of new words, owners of features, their buckets)``, slab by slab over all ``texts``.

    Features are runs of ``least`` to ``most`` words of one text, joined by one space.
    """
    low = [(t or b"").lower() for t in texts]  # of bytes: A-Z only
    joined = _SEPARATOR.join(low) + _SEPARATOR
    starts = np.cumsum(np.array([0, *(len(t) + 1 for t in low[:-1])], np.int64))
    kept, owner_of_kept, at = [], np.empty(0, np.int64), 0
    while at < len(joined):
        gap = _GAP.search(joined, min(at + slab, len(joined) - 1))  # the last byte is one
        found = list(_WORD.finditer(joined, at, gap.start()))
        at = gap.start() + 1
        fresh = np.searchsorted(starts, np.fromiter((m.start() for m in found), np.int64, len(found)), side="right") - 1
        words, owners = kept + [m[0] for m in found], np.concatenate((owner_of_kept, fresh))
        whose, where = [], []
        for n in range(least, most + 1):
            first = np.arange(max(0, len(kept) - n + 1), len(words) - n + 1)  # the last word of the run is new
            first = first[owners[first] == owners[first + n - 1]]
            runs = words if n == 1 else [b" ".join(words[i:i + n]) for i in first.tolist()]
            runs = runs[len(kept):] if n == 1 else runs
            whose.append(owners[first])
            where.append(np.fromiter(map(bucket_of.__getitem__, runs), np.int64, len(first)))
        yield fresh, np.concatenate(whose), np.concatenate(where)
        tail = len(words) - min(len(words), most - 1)
        kept, owner_of_kept = words[tail:], owners[tail:]


def bucket_counts(texts: DataFrame, text_col: str, least: int = 1, most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket; each task adds up its own before anything moves."""

    def count(batches):
        total, bucket_of = np.zeros(buckets, np.int64), _Buckets(buckets)
        for values, _ in chunks(b.column(0) for b in batches):
            for _, _, where in batch_features(values, least, most, bucket_of) if values else ():
                total += np.bincount(where, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    rows = (
        texts.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(count, "bucket int, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # a row per bucket at most
    found = np.zeros(buckets, np.int64)
    for r in rows:
        found[r.bucket] = r.n
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed bucket shares, rounded down."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


_MEASURES = pa.struct([("words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def measures(text: Column, gain: np.ndarray, least: int = 1, most: int = 1) -> Column:
    """``words``, ``n_features`` and ``weight`` (mean gain of the features, rounded down; 0 without any)."""

    @F.arrow_udf("struct<words long, n_features long, weight long>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bucket_of = _Buckets(len(gain))

        def work(texts: list) -> list:
            n = len(texts)
            words, count, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for fresh, whose, where in batch_features(texts, least, most, bucket_of) if texts else ():
                words += np.bincount(fresh, minlength=n)
                count += np.bincount(whose, minlength=n)
                total += np.bincount(whose, weights=gain[where], minlength=n).astype(np.int64)  # exact below 2**53
            weight = total // np.maximum(count, 1)
            return [dict(zip(("words", "n_features", "weight"), r)) for r in zip(words.tolist(), count.tolist(), weight.tolist())]

        yield from per_value(batches, _MEASURES, work)

    return measure(text.cast("binary"))


def noise(id_: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate from a digest of the id, rounded down; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        target_text: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS,
                        least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``(id, text, n_features, weight, score, rank)`` for every row of ``docs``.

    ``rank`` is 1, 2, 3... by falling score for the rows that are drawn: ``percent`` of those with at least
    ``least_words`` words, rounded down; null for the others. Ties go to the smaller id, a null id last; rows
    of one id and score are told apart by their place in the table. Null, empty and wordless texts
    have no features, weight 0, and are never drawn. Repeated rows are rows. An empty target gives every bucket
    the same smoothing; an empty table gives no rows. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col, least, most, buckets), bucket_counts(target, target_text, least, most, buckets))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    measured = rows.select("id", "text", measures(F.col("text"), gain, least, most).alias("_m"))
    scored = measured.select("id", "text", "_m.*").withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    return ranked(scored, least_words, percent)


def ranked(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Add ``rank`` to ``scored(id, words, score, ...)`` and take ``words`` away; see ``importance_resample``."""
    stored = materialize(scored.withColumn("_place", F.monotonically_increasing_id()), "scored")
    could = F.col("words") >= least_words
    drawn = stored.where(could).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("_place")]
    placed = with_position(stored.where(could), order, position="rank")
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1).cast("long").alias("rank")
    columns = [c for c in stored.columns if c not in ("_place", "words")]
    return placed.select(*columns, rank).unionByName(
        stored.where(~could).select(*columns, F.lit(None).cast("long").alias("rank")))
