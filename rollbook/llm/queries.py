"""Registered queries of the operators in this package, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import alignment, language, line_dedup, lm, mixing, ngram_join, packing, pii, quality, spelling, tool_calls, toxicity, vector_search
from rollbook.queries.registry import Query, table
from rollbook.session import materialise

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return add


# --- op3: personal data -------------------------------------------------------------------


def _sql_spans(kind: str, pattern: str, ok: str, extra: bool = False) -> str:
    """Spans of one kind as a list of strings: matches and the pieces between them give the offsets."""
    return f"""
      list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i: struct_pack(
        v := regexp_extract_all(t, '{pattern}')[i],
        s := list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i-1], lambda x: length(x))), 0),
        b := right(string_split_regex(t, '{pattern}')[i], 48), a := left(string_split_regex(t, '{pattern}')[i+1], 48)
      )), lambda m: {ok})"""


_LUHN = """list_sum(list_transform(range(1, length(regexp_replace(m.v, '[^0-9]', '', 'g')) + 1), lambda j:
  CASE WHEN j % 2 = 1 THEN reverse(regexp_replace(m.v, '[^0-9]', '', 'g'))[j]::INT
       ELSE (2 * reverse(regexp_replace(m.v, '[^0-9]', '', 'g'))[j]::INT) // 10
          + (2 * reverse(regexp_replace(m.v, '[^0-9]', '', 'g'))[j]::INT) % 10 END)) % 10 = 0"""
_FIGURES = "length(regexp_replace(m.v, '[^0-9]', '', 'g'))"
_ALONE = "NOT regexp_matches(m.b, '[A-Za-z0-9]$') AND NOT regexp_matches(m.a, '^[A-Za-z0-9]')"


def _sql_score(kind: pii.Kind) -> str:
    return (
        f"({kind.score} + CASE WHEN regexp_matches(lower(m.b || ' ' || m.a), '{kind.near}') THEN 0.3 ELSE 0 END"
        f" - CASE WHEN regexp_matches(lower(m.b || ' ' || m.a), '{kind.far}') THEN 0.3 ELSE 0 END >= {pii.THRESHOLD})"
    )


_KIND = {k.name: k for k in pii.KINDS}
_SQL_KINDS = {
    "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "true"),
    "ip": ("[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)",
           "len(list_filter(string_split(m.v, '.'), lambda p: length(ltrim(p, '0')) > 3"
           " OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0"),
    "card": ("[0-9]([\\x20-]?[0-9])+", f"{_FIGURES} BETWEEN 16 AND 19 AND {_LUHN}"),
    "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", f"{_FIGURES} BETWEEN 8 AND 15"),
    "iban": (_KIND["iban"].pattern,
             "length(replace(m.v, ' ', '')) BETWEEN 15 AND 34 AND"
             " list_reduce(list_concat([0], list_transform(string_split(replace(m.v, ' ', '')[5:] || m.v[1:4], ''), lambda c:"
             " CASE WHEN c = '' THEN 0 ELSE ascii(c) END)), lambda acc, c:"
             " CASE WHEN c = 0 THEN acc WHEN c >= 65 THEN (acc * 100 + c - 55) % 97 ELSE (acc * 10 + c - 48) % 97 END) = 1"
             f" AND {_ALONE} AND {_sql_score(_KIND['iban'])}"),
    "ssn": (_KIND["ssn"].pattern,
            f"NOT regexp_matches(m.v, '^(?:000|666|9)|-00-|-0000$') AND {_ALONE} AND {_sql_score(_KIND['ssn'])}"),
    "shortcard": ("[0-9]([\\x20-]?[0-9])+",
                  f"{_FIGURES} BETWEEN 13 AND 15 AND {_LUHN} AND {_ALONE} AND {_sql_score(_KIND['shortcard'])}"),
}


def _sql_list(kind: str) -> str:
    return f"list_transform({kind}, lambda m: '{kind}:' || m.s || ':' || (m.s + length(m.v)))"


@query("op3_pii", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {", ".join(f"{_sql_spans(k, p, ok)} AS {k}" for k, (p, ok) in _SQL_KINDS.items())} FROM d)
SELECT doc_id, len(email) AS n_email, len(ip) AS n_ip, len(card) AS n_card, len(phone) AS n_phone,
  sha256(array_to_string({" || ".join(_sql_list(k) for k in ("email", "ip", "card", "phone"))}, ',')) AS base_sha256,
  array_to_string({" || ".join(_sql_list(k) for k in _SQL_KINDS)}, ',') AS spans
FROM f""")
def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.with_spans(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *[F.size(f"_pii_{k.name}").cast("long").alias(f"n_{k.name}") for k in pii.KINDS if k.base],
        F.sha2(pii.all_spans(base_only=True), 256).alias("base_sha256"), pii.all_spans().alias("spans"))


# --- op10: mixing -------------------------------------------------------------------------


def _sql_cut(name: str, rows: str, gaps: str) -> str:
    return f"""
{name}_sum AS (SELECT key, h, sum(size) AS words FROM {rows} GROUP BY ALL),
{name}_run AS (SELECT key, h, words, sum(words) OVER (PARTITION BY key ORDER BY h) AS upto FROM {name}_sum),
{name} AS (
  SELECT g.key, coalesce(min(h) FILTER (upto > gap), {1 << mixing.HASH_BITS}) AS cut,
    any_value(gap) - coalesce(max(upto) FILTER (upto <= gap), 0) AS rest,
    coalesce(arg_min(words, h) FILTER (upto > gap), 0) AS unit
  FROM {gaps} g LEFT JOIN {name}_run r ON r.key = g.key GROUP BY g.key)"""


@query("op10_mixing", f"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || coalesce(md5(text), '')), 1, 9))::BIGINT AS h
  FROM documents),
s AS (SELECT key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS weight,
    2 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT key, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS whole FROM t),
g0 AS (SELECT key, CASE WHEN whole >= 2 THEN 0.0 ELSE target - whole * source_size END::DOUBLE AS gap FROM p),
r0 AS (SELECT key, h, size FROM d WHERE size > 0),{_sql_cut("c0", "r0", "g0")},
g1 AS (SELECT key, rest AS gap FROM c0),
r1 AS (SELECT r0.* FROM r0 JOIN c0 USING (key) WHERE h >= cut AND size <= rest),{_sql_cut("c1", "r1", "g1")},
g2 AS (SELECT key, rest AS gap FROM c1),
r2 AS (SELECT r1.* FROM r1 JOIN c1 USING (key) WHERE h >= cut AND size <= rest),{_sql_cut("c2", "r2", "g2")}
SELECT doc_id, size, p.source_size, target, size * (CASE WHEN whole >= 2 THEN 2 ELSE whole + (
    h < c0.cut OR (size <= c0.rest AND h < c1.cut)
    OR (size <= c1.rest AND h < c2.cut + (c2.unit > 0 AND c2.unit <= 2 * c2.rest)::INT))::INT END) AS taken
FROM d JOIN p USING (key) JOIN c0 USING (key) JOIN c1 USING (key) JOIN c2 USING (key)""")
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"), keep=["doc_id"])
    return mixed.select(
        "doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"), (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"))


# --- op7: packing -------------------------------------------------------------------------


@query("op7_packing")
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


# --- op9: exact search --------------------------------------------------------------------


@query("op9_vector_search", """
WITH e AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, place::INT AS rank, vec_id, score FROM r WHERE place <= 10""")
def op9_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    found = vector_search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


# --- op4: languages -----------------------------------------------------------------------


@query("op4_language")
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", language.held_out("doc_id", 4, 2))
    profiles = language.prototypes(docs.filter(~F.col("held_out")))
    found = language.identify(docs.select("doc_id", "held_out", "text"), profiles, prefix="_lang_")
    return found.select("doc_id", "held_out", F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"),
                        F.col("_lang_cosine").alias("cosine"))


# --- op5: quality rules -------------------------------------------------------------------


@query("op5_quality")
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    measured = materialise(quality.statistics(table(spark, folder, "documents")), "statistics")
    rules = quality.learn_rules(measured, table(spark, folder, "labels"))
    failed = quality.base_failed()
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.when(failed, False).otherwise(quality.verdict(rules)).alias("kept"))


# --- op6: near-equal documents ------------------------------------------------------------


@query("op6_ngram_join", """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i+2], ' '))) END AS grams FROM w),
p AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM g),
o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS n, b.n AS m, count(*) AS shared
  FROM p a JOIN p b ON a.gram = b.gram AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT x, y FROM o WHERE 100 * shared >= 90 * (n + m - shared)),
d AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, d.y FROM r JOIN d ON r.y = d.x)
SELECT g.doc_id, len(grams)::BIGINT AS n_shingles, c.component_id
FROM g JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = g.doc_id""")
def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    groups = ngram_join.near_groups(table(spark, folder, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.col("n_grams").alias("n_shingles"), F.col("group_id").alias("component_id"))


# --- op1: toxicity ------------------------------------------------------------------------


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text").withColumn("held_out", language.held_out("doc_id", 3, 1))
    labels = table(spark, folder, "labels").select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    network = toxicity.fit(docs.filter(~F.col("held_out")), labels)
    return toxicity.score(docs, network).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


# --- op2: language model ------------------------------------------------------------------


@query("op2_lm_score")
def op2_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"), language.held_out("doc_id", 7, 2)).withColumnRenamed("id", "doc_id")


# --- op8: tool calls ----------------------------------------------------------------------

SCHEMAS = {
    "search": (tool_calls.Field("limit", "integer", low=1, high=8), tool_calls.Field("query", "string", low=1, high=400)),
    "lookup": (tool_calls.Field("query", "string", low=1), tool_calls.Field("strict", "boolean", required=False)),
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read off plain conversations.

    A user turn calls a tool with its text, depends on the call two turns before, and the turn after
    answers it if it is an assistant's.  Short texts look up, long ones search.
    """
    def call_id(back: int) -> Column:
        return F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - back).cast("string"))

    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1)
    long_text = F.length("text") >= 120
    arguments = F.when(long_text, F.concat(F.lit('{ "query": '), quoted, F.lit(', "limit": '), (F.col("turn") % 10 + 1).cast("string"), F.lit(" }"))).otherwise(
        F.concat(F.lit('{"strict": '), F.when(F.col("turn") > 0, "true").otherwise("false"), F.lit(', "query":'), quoted, F.lit("}")))
    calls = turns.filter("role = 'user'").select(
        "conv_id", "turn", call_id(0).alias("call_id"), F.when(long_text, "search").otherwise("lookup").alias("name"),
        arguments.alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(call_id(2))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    results = turns.filter("role = 'assistant'").select("conv_id", "turn", call_id(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


@query("op8_tool_calls", """
WITH t AS (SELECT conv_id, turn, role, text, 'c' || conv_id || '-' AS stem FROM conversations),
c0 AS (
  SELECT conv_id, turn, stem || turn AS call_id, CASE WHEN length(text) >= 120 THEN 'search' ELSE 'lookup' END AS name,
    text AS query, CASE WHEN length(text) >= 120 THEN '{"limit":' || (turn % 10 + 1) || ',"query":' || to_json(text) || '}'
      ELSE '{"query":' || to_json(text) || ',"strict":' || CASE WHEN turn > 0 THEN 'true' ELSE 'false' END || '}' END AS args,
    CASE WHEN turn >= 2 THEN stem || (turn - 2) END AS needs
  FROM t WHERE role = 'user'),
c AS (SELECT conv_id, call_id, count(*) AS n, arg_min({'turn': turn, 'name': name, 'query': query, 'args': args, 'needs': needs}, (turn, name, args)) AS v
  FROM c0 GROUP BY ALL),
r AS (SELECT conv_id, stem || (turn - 1) AS call_id, count(*) AS n, min((turn, text)) AS v FROM t WHERE role = 'assistant' GROUP BY ALL),
j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.v.turn, r.v[1]) AS turn,
    c.v.name AS name, c.v.query AS query, c.v.args AS args, c.v.needs AS needs, r.v[2] AS content, coalesce(c.n, 0) + coalesce(r.n, 0) AS n_rows,
    CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id),
p AS (
  SELECT *, needs IS NOT NULL AND NOT EXISTS (FROM c WHERE c.conv_id = j.conv_id AND c.call_id = j.needs) AS gap,
    CASE WHEN status <> 'orphan' THEN row_number() OVER (PARTITION BY conv_id, status = 'orphan' ORDER BY turn, call_id) END AS position
  FROM j),
f AS (
  SELECT *, CASE WHEN status = 'orphan' THEN [] ELSE list_concat(
    CASE WHEN name = 'search' AND turn % 10 + 1 > 8 THEN ['range limit'] ELSE [] END, CASE WHEN name = 'search' AND length(query) > 400
      OR length(query) < 1 THEN ['range query'] ELSE [] END, CASE WHEN gap THEN ['missing dependency'] ELSE [] END) END AS faults
  FROM p)
SELECT conv_id, call_id, turn, name, status, n_rows, position, array_to_string(faults, '; ') AS problems, len(faults) = 0 AS valid,
  '{"arguments":' || coalesce(args, 'null') || ',"id":' || to_json(call_id) || ',"name":' || coalesce(to_json(name), 'null') || ',"result":'
    || coalesce(to_json(content), 'null') || '}' AS message
FROM f""")
def op8_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    found = tool_calls.tool_calls(*conversation_calls(table(spark, folder, "conversations")), SCHEMAS)
    return found.select("conv_id", "call_id", "turn", "name", "status", "n_rows", "position", "problems", "valid", "message")


# --- op11: spelling variants --------------------------------------------------------------


@query("op11_spelling")
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    words = materialise(spelling.vocabulary(table(spark, folder, "documents"), alter=spelling.slips), "vocabulary")
    return spelling.variants(words).select("word", "n", "n_near", "form", "form_n", "root")


# --- op12: two tokenizers -----------------------------------------------------------------


@query("op12_alignment")
def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_documents(table(spark, folder, "documents"))[0].withColumnRenamed("id", "doc_id")


# --- op13: repeated lines -----------------------------------------------------------------


@query("op13_line_dedup", f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {line_dedup.CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.DOCUMENTS}),
g AS (SELECT k.*, keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS goes FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '')) AS kept_sha256
FROM g GROUP BY doc_id""")
def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_lines(table(spark, folder, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
