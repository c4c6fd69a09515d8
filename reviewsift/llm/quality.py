"""Quality rules: repetition and length rules, and tokeniser fertility.

Fertility measures what a public vocabulary does to a text: characters per token (ASCII punctuation and symbols
take tokens but are not counted), the share of tokens that fall back to bytes, and the entropy of the token
distribution. A text is rejected when a
measure leaves the band of its script. Words are tokenised once per worker and kept (as piece ids) in
a bounded cache, so a text costs little more than looking its words up.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsift.llm.common import per_value

SYMBOLS = b"#*$%&|<>"
PUNCTUATION = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
#: New words after which a worker's cache becomes the old one and the old one goes; changes time only.
CACHE = 100_000


@dataclass(frozen=True)
class Band:
    """Accepted range of each fertility measure."""

    chars_per_token: tuple[float, float]
    byte_share: float  # at most
    entropy: float  # bits, at least, for texts of ``entropy_tokens`` tokens or more


#: Parameters: bands per script. Prose in alphabets that the vocabulary covers has two to five characters a
#: token, markup, tables and symbol noise fewer; scripts it covers badly have one or less and fall back often. A few hundred tokens of
#: prose carry more than five bits a token; repeated or tabular text carries less.
BANDS: Mapping[str, Band] = {
    "latin": Band((1.6, 12.0), 0.15, 5.0),
    "cyrillic": Band((1.2, 10.0), 0.30, 4.5),
    "greek": Band((0.7, 8.0), 0.50, 4.0),
    "other": Band((0.25, 8.0), 1.00, 3.0),
}
ENTROPY_TOKENS = 200

MEASURES = pa.struct([(n, pa.int64()) for n in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens")] + [
    ("chars_per_token", pa.float64()), ("entropy", pa.float64()), ("script", pa.string())])
MEASURES_DDL = ("struct<n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
                " n_tokens long, n_byte_tokens long, chars_per_token double, entropy double, script string>")


class Pieces:
    """Piece ids of words under a sentencepiece vocabulary of fewer than 65,536 pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        """Make sure that all of ``words`` are in the cache."""
        if len(self.known) > CACHE:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        new = words.difference(known)
        known.update((w, old[w]) for w in new if w in old)
        new = [w for w in new if w not in old]
        encoded = self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1)
        known.update(zip(new, [array("H", e).tobytes() for e in encoded]))

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint16)


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _repeated_words(words: list[bytes]) -> int:
    """Words inside windows that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words))
    rolled = hashes[:n].copy()
    for k in range(1, WINDOW):  # overflow wraps
        rolled *= 0x5851F42D4C957F2D
        rolled += hashes[k:n + k]
    rolled.sort()
    if not (rolled[1:] == rolled[:-1]).any():  # equal windows have equal sums
        return 0
    # exact: name windows of 2, 4 and 8 words by the pair of names of their halves
    ids, size = np.unique(hashes, return_inverse=True)[1].astype(np.int64), 1
    while size < WINDOW:
        pair = ids[:-size] * (int(ids.max()) + 1) + ids[size:]
        ids = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        size *= 2
    again = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _script(text: str) -> str:
    """The script of most letters; ``other`` without letters."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "other"
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    folded = codes | 0x20
    latin = int(((folded >= 0x61) & (folded <= 0x7A)).sum()) + int(((codes >= 0xC0) & (codes <= 0x24F)).sum())
    greek = int(((codes >= 0x370) & (codes <= 0x3FF)).sum())
    cyrillic = int(((codes >= 0x400) & (codes <= 0x52F)).sum())
    other = int((codes > 0x52F).sum())
    most = max(latin, greek, cyrillic, other)
    return "other" if most in (0, other) else "latin" if most == latin else "greek" if most == greek else "cyrillic"


def measure_all(texts: list[bytes | None], vocabulary: Pieces) -> list[dict]:
    split = [(t or b"").split() for t in texts]  # ASCII white space only
    vocabulary.learn(set().union(*split))
    return [_measure(t or b"", words, vocabulary) for t, words in zip(texts, split)]


def _measure(text: bytes, words: list[bytes], vocabulary: Pieces) -> dict:
    plain = b"".join(words).decode("utf-8", "replace")
    lines = Counter(line for line in text.split(b"\n") if not line.isspace() and line)
    tokens = vocabulary.ids(words) if words else np.zeros(0, np.uint16)
    kinds, counts = np.unique(tokens, return_counts=True)
    share = counts / max(1, len(tokens))
    return {
        "n_words": len(words), "word_chars": len(plain),
        "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
        "n_dup_lines": sum(lines.values()) - len(lines),
        "n_repeat_words": _repeated_words(words),
        "n_tokens": len(tokens), "n_byte_tokens": int(counts[vocabulary.is_byte[kinds]].sum()),
        "chars_per_token": len(plain.encode().translate(None, PUNCTUATION).decode()) / max(1, len(tokens)),
        "entropy": float(-(share * np.log2(share)).sum()), "script": _script(plain),
    }


def measure(text: Column, vocabulary: str) -> Column:
    """Struct of the measures of whole texts (see ``MEASURES``); a null text is an empty one.

    ``vocabulary`` is the path of a sentencepiece model that every executor can read.
    """

    @F.arrow_udf(MEASURES_DDL)
    def measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = pieces(vocabulary)
        return per_value(batches, MEASURES, lambda texts: measure_all(texts, model))

    return measures(text.cast("binary"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])


def fertile(m: Column, bands: Mapping[str, Band] = BANDS) -> Column:
    """True where every fertility measure lies in the band of the text's script."""
    verdict = F.lit(False)
    for script, band in bands.items():
        inside = (
            m["chars_per_token"].between(*band.chars_per_token)
            & (m["n_byte_tokens"] <= band.byte_share * m["n_tokens"])
            & ((m["entropy"] >= band.entropy) | (m["n_tokens"] < ENTROPY_TOKENS))
        )
        verdict = F.when(m["script"] == script, inside).otherwise(verdict)
    return verdict


def quality(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, ..., base_failed, kept)`` for every row of ``docs``.

    Null and empty texts have no words and fail; every row is judged by itself, so ties, equal rows and
    null ids need no care. ``kept`` is false for a text that fails the base rules or leaves a
    fertility band. Other columns are not read.
    """
    m = F.col("_m")
    rows = docs.select(F.col(id_col).alias("id"), measure(F.col(text_col), vocabulary).alias("_m"))
    return rows.select("id", "_m.*", base_failed(m).alias("base_failed"), kept(m).alias("kept"))


def kept(m: Column) -> Column:
    return ~base_failed(m) & fertile(m)
