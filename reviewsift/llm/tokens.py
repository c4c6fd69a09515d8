"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as one symbol per byte, linked in a list; the adjacent pair of the lowest rank is popped from
a heap and merged until no pair has a rank. Each merge removes one symbol, so the count is the symbols minus
the merges, and no token ids are made. Each worker keeps the counts of words in a bounded cache.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsift.llm.common import per_value

LIMIT = 2048
#: New words after which a worker's cache becomes the old one and the old one goes; changes time only.
CACHE = 100_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is printable,
    else the next free one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary(dict):
    """Counts of words, filled on demand, of a byte-level BPE tokenizer file with word ends."""

    def __init__(self, path: str):
        super().__init__()
        self.old: dict[str, int] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.known = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.symbols = byte_symbols()
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        # the letters of the newest Unicode version may be newer than the tokenizer library's
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        special = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        self[word] = n = self.merged(word) if n is None else n
        return n

    def trim(self) -> None:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()

    def merged(self, word: str) -> int:
        """Symbols of the word minus merges."""
        parts = [self.symbols[b] for b in word.encode()]
        parts[-1] += self.end
        parts = [p for p in parts if p in self.known]  # a symbol without an entry gives no token
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or ranks.get((parts[i], parts[j])) != rank:
                continue  # one of the two has been merged since
            parts[i], parts[j] = parts[i] + parts[j], None
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return left

    def count(self, text: str | None) -> int:
        """Tokens of a text; its special strings are one token each."""
        if not text:
            return 0
        pieces = self.special.split(text) if self.special else [text]
        total = len(pieces) - 1
        for piece in pieces:
            if not piece.isascii():  # a capital sigma has one lower form here, wherever it stands
                piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
            total += sum(map(self.__getitem__, self.words.findall(piece.lower())))
        return total


@lru_cache(maxsize=4)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(path)


def token_count(text: Column, path: str) -> Column:
    """Tokens of whole texts, without begin or end tokens; 0 for null. Executors read ``path``."""

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = vocabulary_of(path)

        def work(texts: list) -> list[int]:
            vocabulary.trim()
            return [vocabulary.count(t) for t in texts]

        return per_value(batches, pa.int64(), work)

    return counted(text)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for every row; null and empty texts have 0 of each.

    Each row is counted by itself, so equal rows, ties and null ids need no care. Other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(F.col(text_col), path).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
