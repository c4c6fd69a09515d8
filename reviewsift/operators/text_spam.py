"""Users who post repetitive text: TF-IDF vectors and similar pairs within each user.

Copies of a text collapse to one vector with a count. The texts of a user are compared in one task, up to a fixed
number of them. Similar pairs of larger users are found by prefix filtering (Bayardo et al., WWW 2007): two unit
vectors with cosine above the threshold share a term among the rarest few of each, so only those terms are join keys.
Many texts with one such term are keyed by further shared terms instead of being paired (``prefix_groups``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewsift.functions.text import STOP_WORDS, computed_once, term_counts, tokens, with_bigrams, word_count
from reviewsift.operators.ordering import join_hot, likely_members
from reviewsift.operators.prefix_groups import MEMBERS, SLACK, candidate_pairs, ordered_terms
from reviewsift.operators.quantiles import exact_quantiles, melt
from reviewsift.session import materialize

VOCABULARY = 1000
MAX_DF = 0.9
THRESHOLD = 0.9
SIMILARITY_DIGITS = 12  # similarities are rounded to this before they meet the threshold
BUCKETS = 1 << 17  # hash buckets of terms when the most frequent ones are looked for
WHOLE = 4096  # texts of a user that are compared all with all, in one product of matrices
BLOCK = 64  # texts of a user in a block when candidates are verified
CELL = 8192  # texts or candidates in a task's group, on average


def distinct_texts(df: DataFrame, text_col: str = "text", digests: DataFrame | None = None) -> DataFrame:
    """``(text_id, text, copies, digest)``: each different text once; a missing text is ''.

    ``digests(row_id, digest)`` are those of ``df``, if they are stored.
    """
    # texts are grouped by a digest, and each is fetched once by its first row
    rows = df.select("row_id", F.coalesce(text_col, F.lit("")).alias("text"))
    marked = rows.select("row_id", F.sha2("text", 256).alias("digest")) if digests is None else digests
    groups = materialize(
        marked.groupBy("digest").agg(F.min("row_id").alias("text_id"), F.count("*").alias("copies")), "text_digests")
    kept = groups.select(F.col("text_id").alias("row_id"))
    # an inner join follows: a semi-join would be moved below the bitmap's
    first = likely_members(rows, "row_id", kept) if 2 * groups.count() < marked.count() else rows
    return materialize(
        first.join(groups, first["row_id"] == groups["text_id"]).select("text_id", "text", "copies", "digest"), "texts")


def doc_terms(texts: DataFrame, stop_words: Sequence[str] = STOP_WORDS,
              ids: Sequence[str] = ("text_id", "copies")) -> DataFrame:
    """``(*ids, term, tf)`` of unigrams and bigrams, stop words removed first.

    Terms are counted inside the rows; they are only shuffled where rows share their ids, whose counts are added up.
    """
    ids = list(ids)
    found = computed_once(texts.select(*ids, "text"), words=tokens("text", stop_words))
    counted = term_counts(found, with_bigrams("words"), ids)
    if texts.groupBy(*ids).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return counted
    return counted.groupBy(*ids, "term").agg(F.sum("tf").alias("tf"))


def term_stats(terms: DataFrame, texts: DataFrame, max_df: float = MAX_DF) -> DataFrame:
    """``(term, df, tf)`` over all documents; terms in more than ``max_df`` of them are out."""
    documents = texts.agg(F.sum("copies")).scalar()
    return (
        terms.groupBy("term")
        .agg(F.sum("copies").alias("df"), F.sum(F.col("copies") * F.col("tf")).alias("tf"))
        .where(F.col("df") <= F.lit(max_df) * documents)
    )


def frequent_stats(terms: DataFrame, texts: DataFrame, size: int = VOCABULARY, max_df: float = MAX_DF,
                   buckets: int = BUCKETS) -> DataFrame:
    """Those rows of ``term_stats`` that hold its ``size`` most frequent terms, without a shuffle of all terms.

    No term is more frequent than all terms of its hash bucket together. The fullest buckets give ``size`` terms and
    so a least frequency; what lies in buckets below it cannot be among the most frequent.
    """
    hashed = terms.withColumn("_bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    mass = materialize(hashed.groupBy("_bucket").agg(F.sum(F.col("copies") * F.col("tf")).alias("mass")), "term_buckets")

    def counted(chosen: DataFrame) -> DataFrame:
        # at most ``buckets`` rows
        inside = hashed.join(F.broadcast(chosen.select("_bucket")), "_bucket", "left_semi").drop("_bucket")
        return materialize(term_stats(inside, texts, max_df), "frequent_terms")

    fullest = mass.orderBy(F.desc("mass"), "_bucket").limit(4 * size)
    found = counted(fullest)
    least = found.orderBy(F.desc("tf")).limit(size).agg(F.count("*"), F.min("tf")).first()
    enough = least[0] == size
    wanted = mass.where(F.col("mass") >= least[1]) if enough else mass
    return found if wanted.count() <= 4 * size and enough else counted(wanted)


def vocabulary(stats: DataFrame, texts: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """The ``size`` most frequent terms with their idf; ties by term."""
    documents = texts.agg(F.sum("copies")).scalar()
    return (
        stats.orderBy(F.desc("tf"), "term").limit(size)
        .withColumn("idf", F.log((1 + documents) / (1 + F.col("df"))) + 1)
    )


def text_vectors(terms: DataFrame, words: DataFrame) -> DataFrame:
    """``(text_id, copies, term, df, weight)``: unit TF-IDF vectors over the vocabulary."""
    # the vocabulary has a fixed size
    raw = terms.join(F.broadcast(words.select("term", "df", "idf")), "term").withColumn(
        "_w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("text_id")))
    return raw.select("text_id", "copies", "term", "df", (F.col("_w") / norm).alias("weight"))


def packed_vectors(vectors: DataFrame, words: DataFrame) -> DataFrame:
    """``(text_id, terms, weights)``: a vector in one row, its terms by their places in the vocabulary."""
    # the vocabulary has a fixed size
    places = words.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("place"))
    one = vectors.join(F.broadcast(places), "term").groupBy("text_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "weight"))).alias("_v"))
    return one.select("text_id", F.col("_v.place").alias("terms"), F.col("_v.weight").alias("weights"))


def _matrices() -> Callable[[pd.Series, pd.Series], np.ndarray]:
    """Dense rows of packed vectors over the terms that occur. Made here, so it reaches the tasks by value."""

    def matrix(terms: pd.Series, weights: pd.Series) -> np.ndarray:
        rows = np.repeat(np.arange(len(terms)), terms.str.len().to_numpy(dtype=int))
        columns, at = np.unique(np.concatenate(terms.to_numpy()), return_inverse=True)
        out = np.zeros((len(terms), len(columns)))
        out[rows, at] = np.concatenate(weights.to_numpy())
        return out

    return matrix


def _found(group: T.DataType, text: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("group_id", group), T.StructField("text_a", text), T.StructField("text_b", text),
                         T.StructField("similarity", T.DoubleType())])


def similar_in_groups(members: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """``(group_id, text_a, text_b, similarity)`` of the pairs of a group near or above the threshold, all compared.

    ``members(group_id, text_id, n)`` has ``n`` rows per group, a bounded number. Groups share a task's cell.
    """
    cells = 1 + members.count() // CELL
    near, matrix_of = threshold - SLACK, _matrices()

    def compare(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["group_id", "text_id"], ignore_index=True)
        starts = np.flatnonzero(~found["group_id"].duplicated().to_numpy())
        out = [(found["group_id"].iloc[:0], found["text_id"].iloc[:0], found["text_id"].iloc[:0], [])]
        for low, high in zip(starts, [*starts[1:], len(found)]):
            if high - low < 2:
                continue
            matrix = matrix_of(found["terms"].iloc[low:high], found["weights"].iloc[low:high])
            for top in range(0, high - low, 512):  # a part of the rows against those from it on
                product = matrix[top:top + 512] @ matrix[top:].T
                a, b = np.nonzero(np.triu(product, 1) > near)
                if len(a):
                    out.append((found["group_id"].iloc[low + top + a], found["text_id"].iloc[low + top + a],
                                found["text_id"].iloc[low + top + b], product[a, b]))
        return pd.DataFrame({name: np.concatenate([np.asarray(o[i]) for o in out]) for i, name in
                             enumerate(("group_id", "text_a", "text_b", "similarity"))})

    rows = members.select("group_id", "text_id").join(packed, "text_id")
    return rows.withColumn("_cell", F.pmod(F.xxhash64("group_id"), F.lit(cells))).groupBy("_cell").applyInPandas(
        compare, _found(members.schema["group_id"].dataType, members.schema["text_id"].dataType))


def similar_candidates(candidates: DataFrame, sizes: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """``(group_id, text_a, text_b, similarity)`` of the candidates near or above the threshold.

    The texts of a group are dealt into blocks; a vector is sent once to each pair of blocks that has candidates with it,
    not once to each candidate.
    """
    near, matrix_of = threshold - SLACK, _matrices()
    block = lambda c: F.pmod(F.xxhash64(c), F.ceil(F.col("n") / BLOCK))
    cells = 1 + candidates.count() // CELL
    placed = materialize(
        join_hot(candidates, sizes, ["group_id"], "n", "text_a", how="inner")
        .select("group_id", "text_a", "text_b", F.pmod(
            F.xxhash64("group_id", block("text_a"), block("text_b")), F.lit(cells)).alias("_cell")), "placed_candidates")
    used = placed.select(F.col("_cell").alias("_of"), F.explode(F.array("text_a", "text_b")).alias("text_id")).distinct().join(
        packed, "text_id")

    def compare(pairs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        at = pd.Series(np.arange(len(found)), index=found["text_id"])
        a, b = at.reindex(pairs["text_a"]).to_numpy(dtype=int), at.reindex(pairs["text_b"]).to_numpy(dtype=int)
        similarity, step = np.zeros(len(pairs)), 1024
        for low in range(0, len(pairs), step):
            some, place = np.unique(np.concatenate([a[low:low + step], b[low:low + step]]), return_inverse=True)
            matrix, half = matrix_of(found["terms"].iloc[some], found["weights"].iloc[some]), len(place) // 2
            similarity[low:low + step] = np.einsum("ij,ij->i", matrix[place[:half]], matrix[place[half:]])
        return pairs.assign(similarity=similarity)[similarity > near][["group_id", "text_a", "text_b", "similarity"]]

    return placed.groupBy("_cell").cogroup(used.groupBy("_of")).applyInPandas(
        compare, _found(candidates.schema["group_id"].dataType, candidates.schema["text_a"].dataType))


class SpamAnalysis:
    """Stored steps of one analysis; results are derived on demand."""

    def __init__(self, df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD,
                 size: int = VOCABULARY, max_df: float = MAX_DF, stop_words: Sequence[str] = STOP_WORDS,
                 members: int = MEMBERS, whole: int = WHOLE):
        # texts are told apart by their digests from here on
        self.reviews = materialize(df.select("row_id", "user_id", F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("digest")), "review_digests")
        self.threshold, self.members, self.whole = threshold, members, whole
        self.size, self.max_df = size, max_df
        self.texts = distinct_texts(df, text_col, self.reviews.select("row_id", "digest"))
        self.terms = materialize(doc_terms(self.texts, stop_words), "doc_terms")
        self._pairs = self._user_texts = None

    @cached_property
    def stats(self) -> DataFrame:
        return term_stats(self.terms, self.texts, self.max_df)

    @cached_property
    def vocabulary(self) -> DataFrame:
        frequent = frequent_stats(self.terms, self.texts, self.size, self.max_df)
        return materialize(vocabulary(frequent, self.texts, self.size), "vocabulary")

    @cached_property
    def vectors(self) -> DataFrame:
        return materialize(text_vectors(self.terms, self.vocabulary), "vectors")

    @property
    def user_texts(self) -> DataFrame:
        """``(user_id, text_id, row_id, posts)``: the texts of each user with their number."""
        if self._user_texts is None:
            posted = (
                self.reviews.where(F.col("user_id").isNotNull()).groupBy("user_id", "digest")
                .agg(F.count("*").alias("posts"), F.min("row_id").alias("row_id"))
            )
            self._user_texts = materialize(
                join_hot(posted, self.texts.select("digest", "text_id", "copies"), ["digest"], "copies", "user_id", how="inner")
                .select("user_id", "text_id", "row_id", "posts"), "user_texts")
        return self._user_texts

    @property
    def pairs(self) -> DataFrame:
        """``(user_id, text_a, text_b, similarity)`` of different texts above the threshold.

        Up to ``WHOLE`` texts of a user are compared in one task; the texts of larger users are candidates by shared
        terms first.
        """
        if self._pairs is None:
            members = materialize(self.user_texts.select(F.col("user_id").alias("group_id"), "text_id").distinct(), "members")
            sizes = materialize(members.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1"), "user_sizes")
            marked = join_hot(members, sizes, ["group_id"], "n", "text_id", how="inner")
            packed = materialize(packed_vectors(self.vectors, self.vocabulary), "packed")
            found = similar_in_groups(marked.where(F.col("n") <= self.whole), packed, self.threshold)
            if not sizes.where(F.col("n") > self.whole).isEmpty():
                large = materialize(marked.where(F.col("n") > self.whole), "large_users")
                terms = materialize(ordered_terms(self.vectors), "ordered_terms")
                candidates = materialize(
                    candidate_pairs(large.drop("n"), terms, self.threshold, self.members), "candidates")
                found = found.unionByName(similar_candidates(candidates, sizes, packed, self.threshold))
            self._pairs = materialize(
                found.withColumn("similarity", F.round("similarity", SIMILARITY_DIGITS))
                .where(F.col("similarity") > self.threshold).withColumnRenamed("group_id", "user_id"), "pairs")
        return self._pairs

    def user_pairs(self) -> DataFrame:
        """Similar pairs of a user's different texts: first rows, numbers of posts, similarity."""
        side = lambda s: self.user_texts.select(
            "user_id", F.col("text_id").alias(f"text_{s}"), F.col("row_id").alias(f"row_{s}"),
            F.col("posts").alias(f"posts_{s}"))
        both = self.pairs.join(side("a"), ["user_id", "text_a"]).join(side("b"), ["user_id", "text_b"])
        swap = F.col("row_a") > F.col("row_b")
        either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
        return both.select(
            "user_id", either("row_a", "row_b").alias("row_a"), either("row_b", "row_a").alias("row_b"),
            either("posts_a", "posts_b").alias("posts_a"), either("posts_b", "posts_a").alias("posts_b"),
            "similarity")

    def patterns(self, min_reviews: int = 2) -> DataFrame:
        """``(user_id, review_count, avg_similarity)`` of users with a similar pair of reviews.

        Copies of one text count as pairs of similarity 1 (unless the text has no term of the
        vocabulary). The mean is over all similar pairs of the user's reviews.
        """
        worded = self.vectors.select("text_id").distinct()
        copies = F.col("posts") * (F.col("posts") - 1) / 2
        same = self.user_texts.where(F.col("posts") > 1).join(worded, "text_id", "left_semi").select(
            "user_id", copies.alias("pairs"), copies.alias("total"))
        pairs = F.col("posts_a") * F.col("posts_b")
        other = self.user_pairs().select(
            "user_id", pairs.cast("double").alias("pairs"), (pairs * F.col("similarity")).alias("total"))
        similar = same.unionByName(other).groupBy("user_id").agg(
            (F.sum("total") / F.sum("pairs")).alias("avg_similarity"))
        counts = self.user_texts.groupBy("user_id").agg(F.sum("posts").alias("review_count"))
        return counts.where(F.col("review_count") >= min_reviews).join(similar, "user_id").select(
            "user_id", "review_count", "avg_similarity")

    def pattern_reviews(self, min_reviews: int = 2) -> DataFrame:
        """``patterns`` with ``row_ids``: the ids of all reviews of the user, ascending."""
        found = materialize(self.patterns(min_reviews), "patterns")
        rows = join_hot(self.reviews.select("row_id", "user_id"), found, ["user_id"], "review_count", "row_id", how="inner")
        return rows.groupBy("user_id", "review_count", "avg_similarity").agg(
            F.sort_array(F.collect_list("row_id")).alias("row_ids"))

    def spam_users(self, min_reviews: int = 3) -> DataFrame:
        """Patterns of users with at least ``min_reviews`` reviews, those with most reviews first."""
        return self.patterns(min_reviews).orderBy(F.desc("review_count"), "user_id")


def spam_reviews(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """All reviews of the given users, one row each (the nodes of the spam graph).

    ``users`` carries ``review_count``, so a user with very many reviews is spread.
    """
    stored = materialize(users.select("user_id", "review_count"), "spam_users")
    return join_hot(reviews, stored, ["user_id"], "review_count", "row_id", how="inner").drop("review_count")


def spam_graph_cliques(users: DataFrame) -> DataFrame:
    """The edges of the spam graph, one row per user: all reviews of a user are linked to each
    other with the user's mean similarity as weight. The pairs themselves are never written.
    """
    n = F.col("review_count")
    return users.select("user_id", n.alias("nodes"), (n * (n - 1) / 2).cast("bigint").alias("edges"),
                        F.col("avg_similarity").alias("weight"))


def spam_graph_size(users: DataFrame) -> DataFrame:
    return spam_graph_cliques(users).agg(
        F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes"),
        F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"))


def spam_user_lengths(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """Mean words per review of each spam user."""
    return (
        spam_reviews(reviews.select("row_id", "user_id", word_count(F.coalesce("text", F.lit(""))).alias("words")), users)
        .groupBy("user_id").agg(F.avg("words").alias("avg_words"))
    )


def spam_length_stats(lengths: DataFrame) -> DataFrame:
    """Mean, median and population deviation over users of their mean review length."""
    stored = materialize(lengths, "spam_lengths")
    median = exact_quantiles(melt(stored, ["avg_words"]), [0.5]).agg(F.max(F.col("q")[0])).scalar()
    return stored.agg(
        F.avg("avg_words").alias("mean_avg_length"), F.stddev_pop("avg_words").alias("std_avg_length"),
        F.count("*").alias("total_patterns"),
    ).select("mean_avg_length", median.alias("median_avg_length"), "std_avg_length", "total_patterns")
