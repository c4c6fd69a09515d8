"""Text expressions: cleaning, counting, tokens and n-grams. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Character classes. Python's whitespace is Java's Unicode \s plus U+001C-U+001F. Classes of single low
# characters are looked up in a table; the others are tried only for characters beyond them.
SPACE = (r"[[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0]"
         r"[[^\x00-\xff]&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]+")
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
WORD = r"(?U)[^\s\x1c-\x1f]+"
TAG = r"<[^>]+>"
UNPRINTABLE = r"[[^\x20-\x7e]&&\p{C}]"
WORD_CHAR = r"[[abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_][[^\x00-\x7f]&&[\p{L}\p{N}]]]"
TERM = WORD_CHAR + r"{2,}"

# English stop words (Spark's default list, without the contractions, which the
# term pattern never yields).
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn
doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn could would
ought cannot
""".split()


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add (or replace) columns whose expressions are costly, evaluated once per row.

    A one-element explode keeps the optimizer from copying the expressions into every filter
    and projection that uses the columns.
    """
    packed = df.withColumn("_once", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return packed.drop(*columns).select("*", "_once.*").drop("_once")


def clean_text(text: Column | str) -> Column:
    """Strip tags, squeeze whitespace runs to one space, drop unprintable characters.

    No trimming; null gives ''.
    """
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    tagless = F.regexp_replace(col, TAG, "")
    squeezed = F.regexp_replace(tagless, SPACE, " ")
    return F.when(col == " ", F.lit("")).otherwise(F.regexp_replace(squeezed, UNPRINTABLE, ""))


def cleans_to_nothing(text: Column | str) -> Column:
    """Whether ``clean_text`` gives ''; most texts show by their first character that it does not."""
    col = F.col(text) if isinstance(text, str) else text
    stays = F.coalesce(col, F.lit("")).rlike(r"^(?:<[^>]++>){0,8}+[^<\p{C}\p{Z}\s]")
    return F.when(stays, F.lit(False)).otherwise(clean_text(col) == "")


def strip(text: Column | str) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def word_count(text: Column | str) -> Column:
    """Number of whitespace-separated words."""
    return F.regexp_count(text, F.lit(WORD))


def piece_count(text: Column | str) -> Column:
    """Default token count: word runs and single symbols, plus two boundary tokens.

    Words become one letter and white space goes, so what is left has one character a piece; no piece is copied.
    """
    short = F.regexp_replace(text, rf"{WORD_CHAR}++\s*+", "a")
    return F.length(F.regexp_replace(short, r"\s++", "")) + 2


def first_pieces(text: Column | str, pieces: int) -> Column:
    """``text`` up to the end of its piece number ``pieces`` (see ``piece_count``); shorter texts stay whole.

    Only these pieces are read: what follows them is not looked at, unless it is white space up to the end.
    """
    # possessive: no piece is tried twice
    head = rf"^(?:\s*+(?:{WORD_CHAR}++|\S)){{0,{pieces}}}+"
    return F.regexp_extract(text, rf"{head}(?:\s++\z)?+", 0)


def external_token_count(make_tokenizer: Callable[[], Callable[[str], Sequence]]):
    """Token count by a tokenizer of the caller's; built once per task, fed Arrow batches."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_tokenizer()
        for texts in batches:
            yield texts.map(lambda s: len(encode(s)))

    return count


def category_slug(name: Column | str) -> Column:
    return F.lower(F.replace(F.replace(name, F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and")))


def category_from_path(path: Column | str) -> Column:
    """'.../home_and_kitchen_test.csv' gives 'Home And Kitchen', '3d_printers' '3D Printers'; one split suffix
    is dropped. A letter is upper case unless a cased letter stands before it.
    """
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    return title_case(F.replace(F.regexp_replace(stem, "_(test|train|val)$", ""), F.lit("_"), F.lit(" ")))


def title_case(name: Column) -> Column:
    """Every letter that follows no cased letter in upper case, the others in lower case."""
    letters = F.split(F.concat(F.lit(" "), name), "")  # short names
    cased = F.slice(letters, F.lit(1), F.greatest(F.size(letters) - 1, F.lit(0)))
    shifted = F.slice(letters, F.lit(2), F.greatest(F.size(letters) - 1, F.lit(0)))
    return F.array_join(F.zip_with(cased, shifted, lambda before, c: F.when(
        before.rlike(r"[\p{Lu}\p{Ll}\p{Lt}]"), F.lower(c)).otherwise(F.upper(c))), "")


def compose_review_data(category: Column | str, title: Column | str, text: Column | str) -> Column:
    category, title, text = (F.col(c) if isinstance(c, str) else c for c in (category, title, text))
    return F.concat(F.lit("[CAT="), category, F.lit("] [TITLE="), title, F.lit("] "), text)


def tokens(text: Column | str, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-cased terms of two or more word characters, stop words out, order kept."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    if not stop_words:
        return found
    return F.filter(found, lambda t: ~t.isin(*stop_words))  # a hash lookup per token


def with_bigrams(words: Column | str) -> Column:
    """The tokens followed by all pairs of neighbours."""
    w = F.col(words) if isinstance(words, str) else words
    shorter = F.greatest(F.size(w) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(w, F.lit(1), shorter), F.slice(w, F.lit(2), shorter),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>")))


def term_counts(df: DataFrame, terms: Column, kept: Sequence[str]) -> DataFrame:
    """``(*kept, term, tf)``: the different terms of each row with their number, counted inside the row (its terms are
    sorted and the lengths of equal runs taken), so nothing is shuffled. A row without terms gives none.
    """
    found = computed_once(df, _terms=F.sort_array(terms)).select(*kept, "_terms")
    n = F.size("_terms")
    last = lambda i: (i == n) | (F.get("_terms", i - 1) != F.get("_terms", i))
    ends = F.when(n > 0, F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), last))
    runs = F.transform("_ends", lambda e, k: F.struct(
        F.get("_terms", e - 1).alias("term"), (e - F.coalesce(F.get("_ends", k - 1), F.lit(0))).cast("long").alias("tf")))
    return computed_once(found, _ends=ends).select(*kept, F.explode(runs).alias("_run")).select(*kept, "_run.*")
