"""Language identification: the family first, then one-versus-one linear SVMs inside it.

Texts become hashed byte n-gram profiles. A linear support vector machine for each pair of families votes
for the family, one for each pair of its languages votes for the language. The machines are trained by
Spark, a pair per task, on a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewsift.llm.common import chunks, per_value
from reviewsift.session import materialize

#: Language codes (ISO 639-1) by family. Codes that are not listed form the family "other".
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tt",
    "indic": "hi bn ur pa gu mr ne si",
    "iranian": "fa ku ps tg",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "sinitic": "zh",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Parameters. Profiles have DIMENSION counts of hashed n-grams of SIZES bytes; SAMPLE texts a language
#: train its pairs, together SAMPLE texts a family train those of families.
DIMENSION, SIZES, SAMPLE = 4096, (1, 2, 3), 1000
MAX_LANGUAGES = 200
ROUNDS, PENALTY = 150, 1e-4
#: Bytes that are hashed at once, so a text of any length needs bounded memory.
SLAB = 1 << 20

_LETTER = regex.compile(r"\p{L}")


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def profile(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed byte n-gram counts of the lower-cased text."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    counts, longest = np.zeros(DIMENSION), max(SIZES)
    for at in range(0, len(data), SLAB):
        part = data[at:at + SLAB + longest - 1].astype(np.uint32)
        for size in SIZES:
            n = min(len(part) - size + 1, SLAB)
            if n <= 0:
                continue
            h = np.full(n, size, np.uint32)
            for k in range(size):
                h = (h ^ part[k:n + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            counts += np.bincount(h % DIMENSION, minlength=DIMENSION)
    root = np.sqrt(counts)
    return (root / max(1e-9, np.linalg.norm(root))).astype(np.float32)


def fit_pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias (last) of a linear SVM with squared hinge loss; y is -1 or 1."""
    n = len(y)
    weight = np.where(y > 0, n / max(1, (y > 0).sum()), n / max(1, (y < 0).sum())) / (2 * n)
    x = np.hstack([x, np.ones((n, 1), np.float32)])
    w, v = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    step = 1 / (2 * 2.0 + PENALTY)  # rows have length sqrt(2), the weights sum to one
    for t in range(ROUNDS):
        ahead = w + t / (t + 3) * v
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (PENALTY * ahead - 2 * x.T @ (weight * slack * y))
        w, v = new, new - w
    return w


def labelled_sample(rows: DataFrame, per_language: int) -> DataFrame:
    """``(lang, rank, _t)``: up to ``per_language`` different texts a language, those of the smallest hashes.

    ``rows`` has ``id, lang, _t``. Counts are over all rows; a threshold on the hash keeps what is ranked to
    about twice the sample, however many rows a language has.
    """
    keyed = rows.select("lang", F.xxhash64("_t").alias("h"), "id")
    distinct = materialize(keyed.groupBy("lang", "h").agg(F.min("id").alias("id")), "labelled")
    counts = distinct.groupBy("lang").agg(F.count("*").alias("n"))
    share = (F.shiftrightunsigned("h", 11).cast("double") / 2**53) * F.col("n")
    near = distinct.join(F.broadcast(counts.limit(MAX_LANGUAGES + 1)), "lang").where(
        share <= 2 * per_language + 50).drop("n")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picks = materialize(near.withColumn("rank", rank).where(F.col("rank") <= per_language), "picks")
    # at most MAX_LANGUAGES * per_language rows
    joined = rows.withColumn("h", F.xxhash64("_t")).join(
        F.broadcast(picks.withColumnsRenamed({"lang": "_lang", "id": "_id", "h": "_h"})),
        (F.col("h") == F.col("_h")) & (F.col("lang") == F.col("_lang")) & F.col("id").eqNullSafe(F.col("_id")))
    return joined.dropDuplicates(["lang", "h"]).select("lang", "rank", "_t")


def profiles(text: Column) -> Column:
    """Bytes of the ``profile`` of whole texts."""

    @F.arrow_udf("binary")
    def profiled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return per_value(batches, pa.binary(), lambda texts: [profile(t or "").tobytes() for t in texts])

    return profiled(text)


def _train(task: pd.DataFrame) -> pd.DataFrame:
    first = task[["level", "family", "a", "b"]].iloc[0]
    x = np.frombuffer(b"".join(task["x"]), np.float32).reshape(len(task), DIMENSION)
    w = fit_pair(x, np.where(task["side"] == first["a"], 1.0, -1.0))
    return pd.DataFrame({**{k: [first[k]] for k in first.index}, "w": [w.tolist()]})


def train(rows: DataFrame, per_language: int = SAMPLE) -> tuple[list, DataFrame]:
    """Languages ``(lang, family)`` and pair machines ``(level, family, a, b, w)`` from ``id, lang, _t``."""
    sample = labelled_sample(rows, per_language)
    points = materialize(sample.select("lang", "rank", profiles(F.col("_t")).alias("x")), "profiles")
    names = sorted(r.lang for r in points.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    family = {n: FAMILY_OF.get(n.lower().split("-")[0].split("_")[0], "other") for n in names}
    families = sorted(set(family.values()))
    tasks = []  # (lang, rows of it, level, family, a, b, side)
    for n in names:
        mates = [m for m in names if family[m] == family[n]]
        tasks += [(n, per_language, "language", family[n], min(n, m), max(n, m), n) for m in mates if m != n]
        tasks += [(n, max(1, per_language // len(mates)), "family", "", min(family[n], f), max(family[n], f), family[n])
                  for f in families if f != family[n]]
    spark = rows.sparkSession
    plan = spark.createDataFrame(tasks, "lang string, most int, level string, family string, a string, b string, side string")
    machines = (
        points.join(F.broadcast(plan), "lang").where("rank <= most").drop("lang", "rank", "most")
        .groupBy("level", "family", "a", "b")
        .applyInPandas(_train, "level string, family string, a string, b string, w array<double>")
    )
    return [(n, family[n]) for n in names], materialize(machines, "machines")


def _vote(x: np.ndarray, names: list[str], pairs: list[tuple[str, str]], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winner (number of name) and its confidence of each row of x; ties go to the larger margin."""
    if len(names) == 1:
        return np.zeros(len(x), int), np.ones(len(x))
    margin = x @ w[:, :-1].T + w[:, -1]
    votes = np.zeros((len(x), len(names)))
    for k, (a, b) in enumerate(pairs):
        i, j = names.index(a), names.index(b)
        m = np.tanh(margin[:, k]) / (2 * len(names))  # less than a vote in all
        votes[:, i] += (margin[:, k] > 0) + m
        votes[:, j] += (margin[:, k] <= 0) - m
    best = votes.argmax(axis=1)
    least = np.full(len(x), np.inf)
    for k, (a, b) in enumerate(pairs):
        for name, sign in ((a, 1), (b, -1)):
            mine = best == names.index(name)
            least[mine] = np.minimum(least[mine], sign * margin[mine, k])
    return best, 1 / (1 + np.exp(-4 * least))


class Model:
    """Languages and machines, small enough for a task: at most MAX_LANGUAGES languages."""

    def __init__(self, languages: list, machines: list):
        self.families = sorted({f for _, f in languages})
        self.inside = {f: [n for n, g in languages if g == f] for f in self.families}
        self.pairs: dict[str, list] = {f: [] for f in ["", *self.families]}
        weights: dict[str, list] = {f: [] for f in self.pairs}
        for r in sorted(machines, key=lambda r: (r.a, r.b)):
            self.pairs[r.family].append((r.a, r.b))
            weights[r.family].append(r.w)
        self.weights = {f: np.array(w, np.float32) for f, w in weights.items()}

    def predict(self, texts: list) -> list[dict]:
        out = [{"lang_pred": "und", "score": 0.0} for _ in texts]
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        if not known or not self.families:
            return out
        x = np.stack([profile(texts[i]) for i in known])
        family, sure = _vote(x, self.families, self.pairs[""], self.weights[""])
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            if len(rows):
                inside = self.inside[name]
                best, score = _vote(x[rows], inside, self.pairs[name], self.weights[name])
                for r, b, s in zip(rows, best, score * sure[rows]):
                    out[known[r]] = {"lang_pred": inside[b], "score": float(s)}
        return out


def predict(text: Column, model: Model) -> Column:
    """Struct ``lang_pred, score`` of whole texts; ``und`` and 0 without a letter."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang_pred string, score double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        done: list[pa.Array] = []
        for texts, last in chunks(batches):
            for at in range(0, len(texts), 256):
                done.append(pa.array(model.predict(texts[at:at + 256]), kind))
            if last:
                yield pa.concat_arrays(done) if done else pa.array([], kind)
                done = []

    return predicted(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             per_language: int = SAMPLE) -> DataFrame:
    """``(id, held_out, lang_pred, score)`` for every row of ``docs``.

    Learns from rows with a label and a letter whose ``crc32`` of the id (null: empty) leaves another
    remainder than 1 by 3. Null texts and texts without a letter are ``und``, as is everything where nothing is
    labelled. Copies are learnt once, equal rows are predicted alike.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("_t"), F.col(lang_col).cast("string").alias("lang"),
        (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1).alias("held_out"))
    learnt = rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("_t").rlike(r"\p{L}"))
    languages, machines = train(learnt.select("id", "lang", "_t"), per_language)
    model = Model(languages, machines.collect())  # bounded by MAX_LANGUAGES
    return rows.select("id", "held_out", predict(F.col("_t"), model).alias("_p")).select("id", "held_out", "_p.*")
