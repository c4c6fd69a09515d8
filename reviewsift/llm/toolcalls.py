"""Chat formatting: link tool calls to their results, in DataFrame functions only.

Calls and results are hash-joined by conversation and identifier, ordered so that a call follows the call
whose result it uses, validated against the tools' schemas, and written as canonical JSON (sorted keys, no
white space). Rows of a repeated identifier collapse before the join, so no identifier makes pairs.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsift.session import materialize


@dataclass(frozen=True)
class Param:
    """A parameter of a tool; ``kind`` is string, integer, number, boolean, array or object."""

    kind: str
    required: bool = True


Schemas = Mapping[str, Mapping[str, Param]]

#: Start of the type's name in ``schema_of_variant``, by JSON schema type.
_TYPES = {
    "string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "BOOLEAN",
    "array": "ARRAY", "object": "OBJECT",
}


def argument_errors(name: str, arguments: str, schemas: Schemas) -> Column:
    """Sorted array of what is wrong with a call: its tool, its JSON, or its arguments."""
    tool, text = F.col(name), F.col(arguments)
    parsed = F.try_parse_json(text)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    errors = F.array(F.lit("unknown_tool"))
    for known, params in schemas.items():
        found = []
        for param, rule in params.items():
            kind = F.schema_of_variant(F.try_variant_get(parsed, f"$['{param}']", "variant"))
            absent = kind.isNull() | (kind == "VOID")
            found.append(F.when(absent, F.lit(f"missing:{param}") if rule.required else F.lit(None)).when(
                ~kind.rlike(f"^{_TYPES[rule.kind]}"), F.lit(f"type:{param}")))
        extra = F.transform(F.array_except(F.json_object_keys(text), F.array(*[F.lit(p) for p in params])),
                            lambda k: F.concat(F.lit("unexpected:"), k))
        errors = F.when(tool == known, F.array_sort(F.concat(
            F.array_compact(F.array(*found)), F.coalesce(extra, F.array().cast("array<string>"))))).otherwise(errors)
    return F.when(parsed.isNull() | ~is_object, F.array(F.lit("invalid_json"))).otherwise(errors)


def topological_depth(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, depth)`` of ``calls(conv_id, call_id, after)``, a stored table of unique keys.

    ``after`` names a call of the conversation that must come first; a null or unknown one is no
    constraint. Depth counts the calls before, by pointer jumping: each round doubles the distance a call
    looks back. Calls on or behind a cycle have a null depth.
    """
    key = ["conv_id", "call_id"]
    known = calls.select("conv_id", F.col("call_id").alias("after"))
    jump = materialize(
        calls.select(*key, "after").join(known.withColumn("_is", F.lit(True)), ["conv_id", "after"], "left")
        .select(*key, F.when(F.col("_is"), F.col("after")).alias("after"))
        .withColumn("depth", F.when(F.col("after").isNull(), 0).otherwise(1).cast("long")), "jumps")
    longest, n = 1, jump.count()
    while longest <= n and not jump.where("after IS NOT NULL").isEmpty():
        onward = jump.select("conv_id", F.col("call_id").alias("after"), F.col("after").alias("_after"),
                             F.col("depth").alias("_depth"))
        ended = jump.where("after IS NULL")
        moved = jump.where("after IS NOT NULL").join(onward, ["conv_id", "after"]).select(
            *key, F.col("_after").alias("after"), (F.col("depth") + F.col("_depth")).alias("depth"))
        jump = materialize(ended.unionByName(moved), "jumps")
        longest *= 2
    return jump.select(*key, F.when(F.col("after").isNull(), F.col("depth")).alias("depth"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call identifier and per result identifier without a call.

    ``calls(conv_id, call_id, turn, name, arguments, after)`` and ``results(conv_id, call_id, turn, content)``; other
    columns are not read. Of rows that repeat an identifier the first by turn counts (then by their other values), and
    ``n_calls``/``n_results`` tell how many there were. Columns: conv_id, call_id, turn, depth, status
    (``linked``, ``unanswered``, ``early_result`` where the result stands before its call, ``cyclic``, or
    ``orphan_result``), valid, errors, result_turn, json. Ordering by (depth, turn, call_id) is a topological order of a
    conversation's calls. Null identifiers never link: such calls are unanswered, such results orphans, and
    all of a conversation are one row. Null arguments are invalid JSON and left out of ``json``; null
    names are unknown tools. Empty tables give no rows.
    """
    key = ["conv_id", "call_id"]
    first = lambda df, cols: df.groupBy(*key).agg(
        F.min(F.struct("turn", *cols)).alias("_r"), F.count("*").alias("_n"))
    one_call = materialize(
        first(calls, ["name", "arguments", "after"]).select(*key, "_r.*", F.col("_n").alias("n_calls")), "calls")
    one_result = first(results, ["content"]).select(
        *key, F.col("_r.turn").alias("result_turn"), "_r.content", F.col("_n").alias("n_results"))
    depth = topological_depth(one_call.where("conv_id IS NOT NULL AND call_id IS NOT NULL"))
    ordered = one_call.join(depth, key, "left").withColumn(
        "depth", F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), 0).otherwise(F.col("depth")))
    joined = ordered.withColumn("_call", F.lit(True)).join(one_result, key, "full")
    is_call = F.coalesce("_call", F.lit(False))
    status = (
        F.when(~is_call, "orphan_result").when(F.col("depth").isNull(), "cyclic")
        .when(F.col("n_results").isNull(), "unanswered").when(F.col("result_turn") <= F.col("turn"), "early_result")
        .otherwise("linked"))
    checked = joined.withColumn("errors", F.when(is_call, argument_errors("name", "arguments", schemas)))
    return checked.select(
        *key, "turn", "depth", status.alias("status"), (F.size("errors") == 0).alias("valid"), "errors", "result_turn",
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        canonical(F.col("arguments"), F.col("call_id"), F.col("name"), F.col("content")).alias("json"))


def canonical(arguments: Column, call_id: Column, name: Column, content: Column) -> Column:
    """JSON of a call and its result; keys in order (also inside the arguments), no white space, nulls left out."""
    return F.to_json(F.struct(
        F.try_parse_json(arguments).alias("arguments"), call_id.cast("string").alias("id"), name.alias("name"),
        content.alias("result")))
