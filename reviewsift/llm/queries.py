"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsift.llm import (
    decontaminate, language, minhash, mixing, pii, quality, resample, secrets, simhash, tokens, toolcalls, warc, whitening)
from reviewsift.llm.common import table


def vocabulary(name: str) -> str:
    """Path of a public vocabulary; the package that has them is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_round_trip(spark, sf: str) -> DataFrame:
    out = warc.archive_round_trip(table(spark, sf, "pages"))
    # a response is judged by the payload read back
    digest = F.when(F.col("record_type") == "revisit", F.col("payload_digest")).otherwise(warc.base32_sha1(F.col("payload")))
    size = F.when(F.col("record_type") == "revisit", F.col("payload_bytes")).otherwise(F.octet_length("payload"))
    return out.select("page_id", size.cast("long").alias("payload_bytes"), digest.alias("payload_digest"),
                      "record_type", "refers_to")


def op2_mix_sources(spark, sf: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_count_tokens(spark, sf: str) -> DataFrame:
    out = tokens.count_tokens(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))
    return out.withColumnRenamed("id", "doc_id")


def op4_scan_secrets(spark, sf: str) -> DataFrame:
    out = secrets.scan_secrets(table(spark, sf, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex",
                      secrets.digest(F.col("base_spans")).alias("base_sha256"), "spans")


def op5_quality(spark, sf: str) -> DataFrame:
    out = quality.quality(table(spark, sf, "documents"), vocabulary("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "n_byte_tokens", "chars_per_token", "entropy", "script")


def op6_language(spark, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


def op7_personal_data(spark, sf: str) -> DataFrame:
    out = pii.scan_pii(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    return out.withColumn("_base", base).select(
        F.col("id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in pii.KINDS],
        pii.digest(F.col("_base")).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


#: Tools of the calls that ``tool_messages`` makes.
SCHEMAS = {
    "search": {"query": toolcalls.Param("string"), "limit": toolcalls.Param("integer")},
    "measure": {"text": toolcalls.Param("string"), "scale": toolcalls.Param("number", required=False)},
    "lookup": {"key": toolcalls.Param("string"), "exact": toolcalls.Param("boolean")},
}


def tool_messages(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    """Calls and results from ``conversations``: each user turn is a call on its text that uses the result
    of the call two turns before, each assistant turn the result of the call one turn before. Some calls
    are faulty: broken JSON, a missing, mistyped or unexpected argument, an unknown tool.
    """
    turns = table(spark, sf, "conversations")
    call_id = lambda back: F.concat(F.lit("call-"), (F.col("turn") - back).cast("string"))
    n = F.col("conv_id") + F.col("turn")
    text = F.coalesce("text", F.lit(""))
    bad = lambda k: n % 13 == k
    arguments = (
        F.when(bad(1), F.lit('{"query": '))
        .when(n % 3 == 0, F.to_json(F.struct(
            F.when(~bad(2), text).alias("query"),
            F.when(bad(3), F.lit("many")).alias("limit"), F.when(bad(4), F.lit(1)).alias("pages"))))
        .when(n % 3 == 1, F.to_json(F.struct(text.alias("text"), F.lit(0.5).alias("scale"))))
        .otherwise(F.to_json(F.struct(F.lit(True).alias("exact"), F.substring(text, 1, 20).alias("key")))))
    # whole numbers keep their type in the arguments
    arguments = F.when((n % 3 == 0) & ~bad(1) & ~bad(3) & ~bad(2), F.concat(
        F.lit('{ "query" : '), F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", ""), F.lit(', "limit" : '),
        F.col("turn").cast("string"), F.when(bad(4), F.lit(', "pages" : 1')).otherwise(""), F.lit(" }"))
    ).otherwise(arguments)
    tool = F.when(bad(5), "unheard").when(n % 3 == 0, "search").when(n % 3 == 1, "measure").otherwise("lookup")
    calls = turns.where("role = 'user'").select(
        "conv_id", call_id(0).alias("call_id"), "turn", tool.alias("name"), arguments.alias("arguments"),
        call_id(2).alias("after"))
    results = turns.where("role = 'assistant'").select(
        "conv_id", call_id(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op8_link_tool_calls(spark, sf: str) -> DataFrame:
    calls, results = tool_messages(spark, sf)
    out = toolcalls.link_tool_calls(calls, results, SCHEMAS)
    return out.withColumn("errors", F.array_join("errors", ","))


def op9_simhash(spark, sf: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf, "documents"))
    return out.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"),
                      "component_id")


def op10_decontaminate(spark, sf: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      decontaminate.items_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op11_minhash(spark, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


def op12_importance_resampling(spark, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    target = table(spark, sf, "benchmark")
    gain = resample.gains(resample.bucket_counts(docs, "text"), resample.bucket_counts(target, "text"))
    # the texts stay where they are: only their measures are ranked
    scored = docs.select(F.col("doc_id").alias("id"), resample.measures(F.col("text"), gain).alias("_m")).select("id", "_m.*")
    out = resample.ranked(scored.withColumn("score", F.col("weight") + resample.noise(F.col("id"))))
    return out.withColumnRenamed("id", "doc_id")


def op13_whiten_embeddings(spark, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {q.__name__: q for q in (
    op1_warc_round_trip, op2_mix_sources, op3_count_tokens, op4_scan_secrets, op5_quality, op6_language, op7_personal_data,
    op8_link_tool_calls, op9_simhash, op10_decontaminate, op11_minhash, op12_importance_resampling,
    op13_whiten_embeddings)}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_DIGITS = ", ".join(
    f"substr('{warc.BASE32}', CAST(1 + ((CAST('0x' || substr(h, {1 + 5 * i}, 5) AS BIGINT) >> {s}) & 31) AS BIGINT), 1)"
    for i in range(8) for s in (15, 10, 5, 0))
OP1 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, concat({_DIGITS}) AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM f"""

OP2 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
),
s AS MATERIALIZED (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source
),
w AS MATERIALIZED (
  SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, sum(n) OVER () AS total FROM s
),
-- by level: the sources that are full come first; fill(k) is the level at which the others share the rest
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY 3 * n / weight, i) AS k FROM w
),
fill AS (
  SELECT k, total - coalesce(sum(3 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight, n, weight
  FROM ranked
),
edge AS (SELECT min(k) AS k FROM fill WHERE weight * CAST(rest AS DOUBLE) / open_weight <= 3 * n),
targets AS MATERIALIZED (
  SELECT r.source, r.n, CASE WHEN r.k < e.k THEN CAST(3 * r.n AS DOUBLE)
      ELSE r.weight * CAST(f.rest AS DOUBLE) / f.open_weight END AS target
  FROM ranked r, edge e, fill f WHERE f.k = e.k
),
placed AS (
  SELECT d.doc_id, d.size, t.n, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS quota,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
  FROM d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, size, n AS source_size, target,
  CAST(greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - n - start))
    + greatest(0, least(size, quota - 2 * n - start)) AS BIGINT) AS taken
FROM placed"""

OP8 = r"""
WITH RECURSIVE t AS (
  SELECT *, coalesce(text, '') AS body, conv_id + turn AS n FROM conversations
),
c AS MATERIALIZED (
  SELECT conv_id, 'call-' || turn AS call_id, turn, 'call-' || (turn - 2) AS after, body, n,
    CASE WHEN n % 13 = 5 THEN 'unheard' WHEN n % 3 = 0 THEN 'search' WHEN n % 3 = 1 THEN 'measure' ELSE 'lookup' END AS name,
    CASE WHEN n % 13 = 1 THEN NULL
      WHEN n % 3 = 0 THEN '{' || concat_ws(',', CASE WHEN n % 13 = 3 THEN '"limit":"many"' WHEN n % 13 <> 2 THEN '"limit":' || turn END,
        CASE WHEN n % 13 = 4 THEN '"pages":1' END, CASE WHEN n % 13 <> 2 THEN '"query":' || to_json(body) END) || '}'
      WHEN n % 3 = 1 THEN '{"scale":0.5,"text":' || to_json(body) || '}'
      ELSE '{"exact":true,"key":' || to_json(substr(body, 1, 20)) || '}' END AS arguments,
    CASE WHEN n % 13 = 1 THEN 'invalid_json' WHEN n % 13 = 5 THEN 'unknown_tool' WHEN n % 3 <> 0 THEN ''
      WHEN n % 13 = 2 THEN 'missing:limit,missing:query' WHEN n % 13 = 3 THEN 'type:limit'
      WHEN n % 13 = 4 THEN 'unexpected:pages' ELSE '' END AS errors,
    count(*) OVER (PARTITION BY conv_id, turn) AS n_calls, row_number() OVER (PARTITION BY conv_id, turn ORDER BY body) AS copy
  FROM t WHERE role = 'user'
),
r AS MATERIALIZED (
  SELECT conv_id, 'call-' || (turn - 1) AS call_id, turn AS result_turn, text AS content,
    count(*) OVER (PARTITION BY conv_id, turn) AS n_results, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS copy
  FROM t WHERE role = 'assistant'
),
levels AS (
  SELECT conv_id, call_id, CAST(0 AS BIGINT) AS depth FROM c a WHERE copy = 1
    AND NOT EXISTS (SELECT 1 FROM c b WHERE b.conv_id = a.conv_id AND b.call_id = a.after)
  UNION ALL
  SELECT c.conv_id, c.call_id, l.depth + 1 FROM levels l JOIN c ON c.conv_id = l.conv_id AND c.after = l.call_id AND c.copy = 1
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn, l.depth,
  CASE WHEN c.call_id IS NULL THEN 'orphan_result' WHEN r.call_id IS NULL THEN 'unanswered'
    WHEN result_turn <= c.turn THEN 'early_result' ELSE 'linked' END AS status,
  c.errors = '' AS valid, c.errors, result_turn, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
  '{' || concat_ws(',', '"arguments":' || c.arguments, '"id":"' || coalesce(c.call_id, r.call_id) || '"', '"name":"' || name || '"',
    '"result":' || to_json(content)) || '}' AS json
FROM (SELECT * FROM c WHERE copy = 1) c FULL JOIN (SELECT * FROM r WHERE copy = 1) r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
  LEFT JOIN levels l ON l.conv_id = c.conv_id AND l.call_id = c.call_id"""

OP10 = rf"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
windows AS MATERIALIZED (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, pos, pos + least(10, len(w)) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM items WHERE len(w) > 0)
),
docs AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
places AS (
  SELECT d.doc_id, l.n, pos, array_to_string(list_slice(d.w, pos, pos + l.n - 1), ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS pos FROM docs) d, (SELECT DISTINCT n FROM windows) l
  WHERE pos + l.n - 1 <= len(d.w)
),
hits AS MATERIALIZED (SELECT DISTINCT p.doc_id, p.pos, p.n, p.win FROM places p JOIN (SELECT DISTINCT n, win FROM windows) USING (n, win)),
cover AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS word FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT h.doc_id, w.item FROM hits h JOIN windows w USING (n, win)) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
  sha256(coalesce(m.list, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN cover c USING (doc_id) LEFT JOIN named m USING (doc_id)"""

OP12 = rf"""
WITH poly AS (  -- the table of crc32, by its rule
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(256) t(i))
),
words AS MATERIALIZED (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark
),
counted AS MATERIALIZED (SELECT side, id, word, count(*) AS n FROM (SELECT side, id, unnest(w) AS word FROM words) GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(hex(encode(word))), 2),
      lambda i: CAST('0x' || substr(hex(encode(word)), i, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM counted), poly
),
sums AS MATERIALIZED (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t
  FROM counted JOIN hashed USING (word) GROUP BY bucket
),
gained AS (
  SELECT bucket, floor(1000 * ln((CAST(t AS DOUBLE) + 1) * ((SELECT sum(s) FROM sums) + 10000)
    / ((CAST(s AS DOUBLE) + 1) * ((SELECT sum(t) FROM sums) + 10000)))) AS gain FROM sums
),
weighed AS (
  SELECT id, floor(sum(n * gain) / sum(n)) AS weight FROM counted JOIN hashed USING (word) JOIN gained USING (bucket)
  WHERE side = 'd' GROUP BY id
),
scored AS MATERIALIZED (
  SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_features, CAST(coalesce(g.weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(g.weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln(
      (CAST('0x' || substr(sha256('2024:' || w.id), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM words w LEFT JOIN weighed g ON g.id = w.id WHERE w.side = 'd'
),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT s.*, CASE WHEN p.rank <= (SELECT 10 * count(*) // 100 FROM placed) THEN p.rank END AS rank
FROM scored s LEFT JOIN placed p USING (doc_id)"""


def _spans_sql(rule: secrets.Rule) -> str:
    """Spans of one rule: lengths of the matches and of the gaps between them, summed up."""
    p = rule.pattern.replace("'", "''")
    tested = f"regexp_extract_all(text, '{p}', {rule.group})"
    return f"""
  SELECT doc_id, '{rule.kind}' AS kind, list_sum(gaps[:i]) + coalesce(list_sum(sizes[:i - 1]), 0) AS s, sizes[i] AS size
  FROM (SELECT *, unnest(range(1, len(sizes) + 1)) AS i FROM (
    SELECT doc_id, list_transform(regexp_split_to_array(text, '{p}'), lambda x: length(x)) AS gaps,
      list_transform(regexp_extract_all(text, '{p}'), lambda x: length(x)) AS sizes,
      list_transform({tested}, lambda x: length(x)) AS tested
    FROM documents WHERE regexp_matches(text, '{p}')))
  WHERE tested[i] >= {rule.least}"""


_KINDS = ", ".join(f"'{r.kind}'" for r in secrets.RULES)
OP4 = f"""
WITH spans AS MATERIALIZED ({" UNION ALL ".join(map(_spans_sql, secrets.RULES))}),
named AS (
  SELECT *, list_position([{_KINDS}], kind) AS k,
    kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + size AS BIGINT) AS VARCHAR) AS span FROM spans
),
found AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)},
    string_agg(span, ',' ORDER BY s, k) FILTER (k <= {len(secrets.BASE)}) AS base,
    string_agg(span, ',' ORDER BY s, k) AS spans
  FROM named GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id"""

ORACLES = {"op1_warc_round_trip": OP1, "op2_mix_sources": OP2, "op4_scan_secrets": OP4, "op8_link_tool_calls": OP8,
           "op10_decontaminate": OP10, "op12_importance_resampling": OP12}
