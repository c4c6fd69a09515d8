"""Text to rating, trained in epochs: averaged gradient steps, validation, the best epoch kept, resumable.

Texts become hashed terms once; both tables of them are stored in the run's folder. In an epoch each task takes its
rows in small batches from the current weights, and the tasks' weights are averaged by their rows; only sums per
weight are shuffled. Weights and validation error of every epoch are stored, so a run that stops goes on after its
last whole epoch and ends with the same weights as one that did not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsift.functions.text import STOP_WORDS, computed_once, tokens
from reviewsift.operators.rating_model import truncated
from reviewsift.operators.validate import MAX_TOKENS

#: Rows of one gradient step.
STEP_ROWS = 16


@dataclass(frozen=True)
class RatingWeights:
    """A weight per hashed term, the inverse document frequencies and the intercept; ``epoch`` that gave them."""

    weights: np.ndarray
    idf: np.ndarray
    intercept: float
    epoch: int

    def predict(self, terms: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *map(len, terms)])
        flat = np.concatenate([np.asarray(t, np.int64) for t in terms]) if len(terms) else np.empty(0, np.int64)
        row, at, value = _sparse(flat, starts, self.idf)
        return self.intercept + np.bincount(row, weights=value * self.weights[at], minlength=len(terms))


def _counted(flat: np.ndarray, starts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, their different buckets and how often each comes; the buckets of row ``i`` are ``flat[starts[i]:starts[i + 1]]``."""
    key = np.repeat(np.arange(len(starts) - 1) * buckets, np.diff(starts)) + flat
    if not (key[1:] >= key[:-1]).all():  # stored rows are sorted
        key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
    row, at = np.divmod(key[first], buckets)
    return row, at, np.diff(np.r_[first, len(key)])


def _sparse(flat: np.ndarray, starts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, buckets and values of unit TF-IDF vectors."""
    row, at, count = _counted(flat, starts, len(idf))
    value = count * idf[at]
    square = np.bincount(row, weights=value * value, minlength=len(starts) - 1)
    return row, at, value / np.sqrt(np.maximum(square, 1e-12))[row]


def _flat(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all rows of a list column, and where each row's begin."""
    starts = terms.offsets.to_numpy()
    return terms.values.to_numpy()[starts[0]:starts[-1]].astype(np.int64), starts - starts[0]


def hashed_terms(df: DataFrame, text_col: str, buckets: int, max_tokens: int | None = MAX_TOKENS) -> DataFrame:
    """Add ``terms``: the buckets of a text's words and word pairs; none for a null text."""
    text = truncated(F.coalesce(text_col, F.lit("")), max_tokens)
    found = computed_once(df, _words=tokens(text, STOP_WORDS))
    bucket = lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int")
    words, shorter = F.col("_words"), F.greatest(F.size("_words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), shorter), F.slice(words, F.lit(2), shorter),
                       lambda a, b: bucket(F.concat(a, F.lit(" "), b)))
    both = F.concat(F.transform(words, bucket), F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<int>")))
    return found.withColumn("terms", F.sort_array(both)).drop("_words")


def _document_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Rows that have a bucket, for every bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            seen += np.bincount(_counted(*_flat(batch.column(0)), buckets)[1], minlength=buckets)
        kept = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(seen[kept])], ["i", "n"])

    found = rows.select("terms").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets)
    out[found["i"].to_numpy()] = found["n"].to_numpy()  # a row per bucket at most
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _stored(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    if not _exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _epoch(rows: DataFrame, state: RatingWeights, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Weights and intercept after one epoch, averaged over the tasks."""
    buckets = len(state.weights)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, n, past = state.weights.copy(), state.intercept, 0, np.zeros(buckets)
        for batch in batches:
            label, size = batch.column(0).to_numpy(), batch.num_rows
            row, at, value = _sparse(*_flat(batch.column(1)), state.idf)
            low = np.searchsorted(row, np.arange(0, size + STEP_ROWS, STEP_ROWS))
            for k, start in enumerate(range(0, size, STEP_ROWS)):
                y, some = label[start:start + STEP_ROWS], slice(low[k], low[k + 1])
                r, a, v = row[some] - start, at[some], value[some]
                off = b + np.bincount(r, weights=v * w[a], minlength=len(y)) - y
                slope = np.bincount(a, weights=v * off[r], minlength=buckets) / len(y)
                moved = np.flatnonzero(slope)
                slope = slope[moved]
                past[moved] += slope * slope  # steps of a weight shrink with its past slopes, so no rate diverges
                w *= 1 - rate * decay
                w[moved] -= rate * slope / np.sqrt(past[moved] + 1e-12)
                b -= rate * off.mean()
                n += len(y)
        if n:
            moved = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[-2, -1, moved]), pa.array(np.r_[float(n), n * b, n * w[moved]])], ["i", "v"])

    sums = rows.select("label", "terms").mapInArrow(steps, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    at, v = sums["i"].to_numpy(), sums["v"].to_numpy()  # a row per bucket at most
    total = v[at == -2].sum() or 1.0
    weights = np.zeros(buckets)
    weights[at[at >= 0]] = v[at >= 0] / total
    return weights, float(v[at == -1].sum() / total)


def with_predictions(df: DataFrame, model: RatingWeights, text_col: str = "review_data",
                     max_tokens: int | None = MAX_TOKENS) -> DataFrame:
    """Add ``predicted_rating`` and ``rating_diff``; a text without terms gets the intercept."""
    plain = df.drop("predicted_rating", "rating_diff")
    scored = hashed_terms(plain, text_col, len(model.weights), max_tokens).withColumn("predicted_rating", _predictor(model)("terms"))
    return scored.drop("terms").withColumn("rating_diff", F.abs(F.col("predicted_rating") - F.col("rating")))


def _predictor(model: RatingWeights):
    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for terms in batches:
            yield pd.Series(model.predict(terms.tolist()), dtype="float64")

    return predict


def train_epochs(train: DataFrame, val: DataFrame, folder: str, epochs: int = 5, rate: float = 0.2, decay: float = 1e-5,
                 buckets: int = 1 << 14, text_col: str = "review_data", label: str = "rating",
                 max_tokens: int | None = MAX_TOKENS) -> RatingWeights:
    """The weights of the epoch with the least validation error (the earliest in a tie).

    ``folder`` keeps the hashed tables and a table per epoch; a second call with the same folder goes on from there.
    Rows without a label are left out. ``epochs`` 0, or no training rows, gives the constant model.
    """
    spark = train.sparkSession
    rows_of = lambda df: hashed_terms(
        df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), text_col), text_col, buckets, max_tokens
    ).select("label", "terms")
    rows, held = _stored(rows_of(train), f"{folder}/train"), _stored(rows_of(val), f"{folder}/val")
    n, mean = rows.agg(F.count("*"), F.avg("label")).first()
    seen = _document_counts(rows, buckets)
    state = RatingWeights(np.zeros(buckets), np.log((1 + n) / (1 + seen)) + 1, mean or 0.0, 0)
    best, least = state, _error(held, state)
    for epoch in range(1, epochs + 1):
        path = f"{folder}/epoch={epoch}"
        if not _exists(spark, f"{path}/_SUCCESS"):
            weights, intercept = _epoch(rows, state, rate, decay)
            error = _error(held, RatingWeights(weights, state.idf, intercept, epoch))
            kept = np.flatnonzero(weights)
            spark.createDataFrame(pd.DataFrame({
                "i": np.r_[-2, -1, kept], "v": np.r_[error, intercept, weights[kept]]})).coalesce(1).write.mode("overwrite").parquet(path)
        stored = spark.read.parquet(path).toPandas()
        at, v = stored["i"].to_numpy(), stored["v"].to_numpy()
        weights = np.zeros(buckets)
        weights[at[at >= 0]] = v[at >= 0]
        state, error = RatingWeights(weights, state.idf, float(v[at == -1][0]), epoch), float(v[at == -2][0])
        if error < least:
            best, least = state, error
    return best


def _error(held: DataFrame, model: RatingWeights) -> float:
    """Root mean square error on ``held(label, terms)``; infinite without rows."""
    off = F.col("label") - _predictor(model)("terms")
    found = held.select(off.alias("off")).agg(F.sqrt(F.avg(F.col("off") * F.col("off")))).first()[0]
    return float("inf") if found is None else float(found)


def epoch_errors(spark: SparkSession, folder: str) -> DataFrame:
    """``(epoch, rmse)`` of a run's epochs on its validation rows."""
    return spark.read.parquet(*[f"{folder}/epoch=*"]).withColumn(
        "epoch", F.regexp_extract("_metadata.file_path", r"epoch=(\d+)", 1).cast("int")).where("i = -2").select(
        "epoch", F.col("v").alias("rmse"))
