"""From raw reviews to cleaned, deduplicated and split datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsift.operators.dedup import repeated_ids, row_digest
from reviewsift.operators.ordering import small, without_ids
from reviewsift.operators.splits import split_by, split_dataset, split_limits
from reviewsift.operators.validate import valid_reviews
from reviewsift.session import materialize


def build_dataset(raw: DataFrame, train_n: int, val_n: int, test_n: int, **options) -> DataFrame:
    """``row_id``, the 13 dataset columns and ``split``, all categories in one plan.

    The raw rows are capped at the requested total per category before any filter, as the
    first rows of each category; the training split drops repeats of (review_data, rating).

    Rows are cleaned and digested once and stored. Both kinds of repeats and the splits are found among ids and
    digests; the stored rows are read once more, to meet the splits' limits and the repeats' ids.
    """
    first = split_dataset(raw, train_n + val_n + test_n, 0, 0).drop("split")
    valid = valid_reviews(first, **options)
    digests = {"_row": row_digest(valid, [c for c in valid.columns if c != "row_id"]), "_text": F.sha2("review_data", 256)}
    valid = materialize(valid.withColumns(digests), "valid")
    marks = valid.select("row_id", "category", "rating", "_row", "_text")
    copies = small(repeated_ids(marks.select("row_id", "_row"), ["_row"]))
    marks = materialize(marks.join(copies, "row_id", "left_anti").drop("_row"), "marks")
    limits = small(materialize(split_limits(marks, train_n, val_n, test_n), "split_limits"))
    train = split_by(marks, limits).where(F.col("split") == "train").select("row_id", "_text", "rating")
    repeats = repeated_ids(materialize(train, "train_marks"), ["_text", "rating"])
    dropped = materialize(copies.unionByName(repeats), "dropped")
    return without_ids(split_by(valid.drop("_row", "_text"), limits), "row_id", dropped, valid)
