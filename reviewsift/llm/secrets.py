"""Secret scan with a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean trigram query is derived: an AND of clauses, each an OR of trigram sets
that every match must contain. The index maps each trigram of those queries to the documents that hold it;
its postings are intersected, and only candidates are verified with the regex. A rule without
mandatory trigrams scans all documents.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewsift.llm.common import EMPTY_SHA256, ascii_lower, bounded, row_key, same
from reviewsift.session import materialize


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # without flags, in the syntax that Java, Python and RE2 share
    group: int = 0  # matches count where this group has at least ``least`` characters
    least: int = 1
    # for Java only: the same matches as its group 1, and more (group 1 not taken part) where a run that holds
    # none would else be scanned again from each place in it
    scan: str = ""


def either_case(word: str) -> str:
    """ASCII letters in either case; flags would fold other letters in some engines."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))

BASE = (
    Rule("assign", f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    # runs of 20 and of 24 characters: a shorter run holds no longer one, so asking for the length in the
    # pattern finds the same spans and makes no short matches
    Rule("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
#: Spans beyond the base kinds; fixed prefixes of widely used credential formats. No length is bounded but that of
#: an address's scheme, whose last characters do.
_RUN = "[A-Za-z0-9_-]+"
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", f"eyJ{_RUN}\\.eyJ{_RUN}\\.{_RUN}", 0, 40, f"(eyJ{_RUN}+\\.eyJ{_RUN}+\\.{_RUN}+)|eyJ{_RUN}+"),
    # neither the user's nor the password's characters hold those around them, so every run is scanned a few times only
    Rule("url_password", "[A-Za-z][A-Za-z0-9+.-]{1,15}://[A-Za-z0-9._%-]+:[A-Za-z0-9._%!*-]+@", 0, 12),
)
RULES = BASE + MORE

#: Strings that one clause of a trigram query may enumerate.
MAX_STRINGS = 64

Query = list[list[frozenset[str]]]


def _strings(items) -> set[str] | None:
    """All strings of a parsed regex part in lower case, None where they are too many to list."""
    found = {""}
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            more = {chr(arg).lower()}
        elif name == "IN":
            if any(str(o) != "LITERAL" for o, _ in arg):
                return None
            more = {chr(v).lower() for _, v in arg}
        elif name == "SUBPATTERN":
            more = _strings(arg[3])
        elif name == "BRANCH":
            parts = [_strings(b) for b in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif name == "MAX_REPEAT" and arg[1] == 1:
            more = _strings(arg[2])
            more = None if more is None else more | {""} if arg[0] == 0 else more
        elif name == "MAX_REPEAT" and arg[0] == arg[1]:
            more = _strings(list(arg[2]) * int(arg[0]))
        elif name == "AT":
            more = {""}
        else:
            more = None
        if more is None or len(found) * len(more) > MAX_STRINGS:
            return None
        found = {a + b for a in found for b in more}
    return found


def trigram_query(pattern: str) -> Query:
    """Clauses that a text with a match must all meet; each is a choice of trigram sets (lower case)."""
    clauses: Query = []

    def close(strings: set[str]) -> None:
        sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
        if all(sets):
            clauses.append(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))

    run = {""}
    for item in regex_parser.parse(pattern):
        more = _strings([item])
        if more is not None and len(run) * len(more) <= MAX_STRINGS:
            run = {a + b for a in run for b in more}
        else:
            close(run)
            run = more if more is not None else {""}
    close(run)
    return clauses


def _any_of(strings: Sequence[str]) -> str:
    """Regex for one of the strings, as a tree of their first characters."""
    heads: dict[str, list[str]] = {}
    for s in sorted(strings):
        heads.setdefault(s[:1], []).append(s[1:])
    parts = [re.escape(h) + ("" if rest == [""] else f"(?:{_any_of(rest)})" if len(rest) > 1 else re.escape(rest[0]))
             for h, rest in heads.items()]
    return "|".join(parts)


def trigram_index(texts: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """Postings ``(trigram, id, key)``: the given trigrams in each ``_t``, ASCII case folded, once per row."""
    found = F.regexp_extract_all(ascii_lower(F.col("_t")), F.lit(f"(?=({_any_of(sorted(set(trigrams)))}))"), F.lit(1))
    return texts.select("id", "key", F.explode(F.array_distinct(found)).alias("trigram"))


def candidates(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(id, key, kinds)``: rows that meet the trigram queries of ``rules``, all of which have one."""
    terms = []
    for r in rules:
        clauses = trigram_query(r.pattern)
        for c, choice in enumerate(clauses):
            for s, needed in enumerate(choice):
                terms += [(t, r.kind, c, s, len(needed), len(clauses)) for t in sorted(needed)]
    spark = texts.sparkSession
    queries = spark.createDataFrame(
        terms, "trigram string, kind string, clause int, choice int, n_terms int, n_clauses int")
    postings = trigram_index(texts, [t[0] for t in terms]).distinct()
    return (
        postings.join(F.broadcast(queries), "trigram")  # a few rows per rule
        .groupBy("id", "key", "kind", "clause", "choice", "n_terms", "n_clauses").count()
        .where(F.col("count") == F.col("n_terms"))
        .groupBy("id", "key", "kind", "n_clauses").agg(F.count_distinct("clause").alias("met"))
        .where(F.col("met") == F.col("n_clauses"))
        .groupBy("id", "key").agg(F.collect_set("kind").alias("kinds"))
    )


def _matches(texts: DataFrame, rule: Rule) -> DataFrame:
    """``(id, key, kind, pos, gap, size, ok)`` per match: characters before it since the last one, its own."""
    pattern, group = (rule.scan, 1) if rule.scan else (rule.pattern, rule.group)
    whole = F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))
    tested = whole if group == 0 else F.regexp_extract_all("_t", F.lit(pattern), F.lit(group))
    lengths = lambda a: F.transform(a, F.length)
    gaps = F.slice(lengths(F.split("_t", pattern, -1)), F.lit(1), F.size(whole))
    return (
        texts.where(F.col("_t").rlike(pattern))
        .select("id", "key", F.posexplode(F.arrays_zip(
            gaps.alias("gap"), lengths(whole).alias("size"), lengths(tested).alias("tested"))).alias("pos", "m"))
        .select("id", "key", F.lit(rule.kind).alias("kind"), "pos", "m.gap", "m.size",
                (F.col("m.tested") >= rule.least).alias("ok"))
    )


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(id, key, kind, start, end)`` of the secrets in whole texts, in code points, end exclusive.

    Per rule, leftmost non-overlapping matches whose tested group is long enough. Null and empty texts
    have none. Equal rows give their spans once; ``key`` tells different texts of an id apart.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t")).where(F.col("_t").isNotNull())
    texts = texts.select("id", row_key(F.col("_t")).alias("key"), "_t")
    indexed = [r for r in rules if trigram_query(r.pattern)]
    found = None
    if indexed:
        hits = bounded(materialize(candidates(texts, indexed), "secret-candidates"))
        chosen = materialize(
            texts.join(hits, same(texts, hits, "id", "key")).select(texts["id"], texts["key"], "_t", "kinds"),
            "secret-texts")
        for r in indexed:
            rows = _matches(chosen.where(F.array_contains("kinds", r.kind)), r)
            found = rows if found is None else found.unionByName(rows)
    for r in rules:
        if r not in indexed:
            rows = _matches(texts, r)
            found = rows if found is None else found.unionByName(rows)
    # equal rows repeat their matches
    found = found.distinct()
    before = Window.partitionBy("id", "key", "kind").orderBy("pos")
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    return (
        found.withColumn("end", end).where("ok")
        .select("id", "key", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    )


def span_list(kinds: Sequence[str], spans: str = "_spans") -> Column:
    """``kind:start:end`` of an array of (start, number of kind, end), by start, then kind."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", names[s["k"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: Sequence[Rule] = RULES, base: Sequence[str] = tuple(r.kind for r in BASE)) -> DataFrame:
    """``(id, key, n_<base kind>..., base_spans, spans)`` for every row of ``docs``.

    The span lists are strings ``kind:start:end``, comma-joined by start, then by the order of ``rules``;
    empty for rows without secrets (null, empty and clean texts).
    """
    kinds = [r.kind for r in rules]
    number = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")).cast("int") - 1
    spans = secret_spans(docs, id_col, text_col, rules).withColumn("k", number)
    place = F.struct("start", "k", "end")
    per_row = spans.groupBy("id", "key").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in base],
        F.collect_list(F.when(F.col("kind").isin(*base), place)).alias("_base"),
        F.collect_list(place).alias("_all"),
    ).select("id", "key", *[f"n_{k}" for k in base], span_list(kinds, "_base").alias("base_spans"),
             span_list(kinds, "_all").alias("spans"))
    found = materialize(per_row.withColumnsRenamed({"id": "_id", "key": "_key"}), "secrets")
    rows = docs.select(F.col(id_col).alias("id"), row_key(F.col(text_col)).alias("key"))
    return rows.join(found, rows["id"].eqNullSafe(found["_id"]) & (rows["key"] == found["_key"]), "left").select(
        "id", "key", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base],
        F.coalesce("base_spans", F.lit("")).alias("base_spans"), F.coalesce("spans", F.lit("")).alias("spans"))


def digest(spans: Column) -> Column:
    return F.when(spans == "", F.lit(EMPTY_SHA256)).otherwise(F.sha2(spans, 256))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES,
           mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span (overlapping ones merged) replaced by ``mark``; all rows and columns stay."""
    spans = secret_spans(docs, id_col, text_col, rules)
    order = Window.partitionBy("id", "key").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = (
        spans.withColumn("_new", F.when(F.col("start") < reach, 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("id", "key", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    )
    cuts = bounded(materialize(merged.withColumnsRenamed({"id": "_id", "key": "_key"}), "cuts"))
    t, n = F.col(text_col), F.size("_cuts")
    kept = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(
        t, F.when(i == 0, 0).otherwise(F.try_element_at("_cuts", i)["end"]).cast("int") + 1,
        (F.when(i < n, F.try_element_at("_cuts", i + 1)["start"]).otherwise(F.length(t))
         - F.when(i == 0, 0).otherwise(F.try_element_at("_cuts", i)["end"])).cast("int"))), mark)
    joined = docs.withColumn("_row", row_key(t)).join(
        cuts, docs[id_col].eqNullSafe(cuts["_id"]) & (F.col("_row") == cuts["_key"]), "left")
    return joined.withColumn(text_col, F.when(F.col("_cuts").isNull(), t).otherwise(kept)).select(*docs.columns)
