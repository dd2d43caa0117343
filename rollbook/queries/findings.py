"""Findings, evidence and lessons derived from the labels, orders and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.predicates import condition
from rollbook.operators import evidence as ev
from rollbook.operators import lessons as le
from rollbook.operators.numbering import number_rows
from rollbook.queries.filters import orders_by_priority
from rollbook.queries.registry import query, table
from rollbook.session import scratch_path
from rollbook.sources.register import parse_findings, raw_view


def cited_labels(spark: SparkSession, folder: str) -> DataFrame:
    """A finding per source and language: toxic documents support it, clean ones counter it."""
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    documents = table(spark, folder, "documents").select("doc_id", "source", "lang")
    return labels.join(documents, "doc_id").select(
        F.concat_ws("/", "source", "lang").alias("finding_id"),
        F.when(F.col("toxic") == 1, "supporting").otherwise("counter").alias("evidence_type"),
        F.col("doc_id").alias("position"),
        F.col("doc_id").cast("string").alias("record_id"),
    )


def headers_of(cited: DataFrame) -> DataFrame:
    """A header for each cited finding; the confidence wording is left to be coerced."""
    sizes = cited.groupBy("finding_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select(
        "finding_id",
        F.lit("root_cause_pattern").alias("finding_type"),
        F.concat(F.lit("Toxic text in "), F.col("finding_id")).alias("claim"),
        ev.coerce_confidence(F.when(F.col("n") >= 10, "high").when(F.col("n") <= 2, "low").otherwise("unsure")).alias("confidence"),
        F.array(
            F.concat(F.lit("check the feed of "), F.substring_index("finding_id", "/", 1)),
            F.concat(F.lit("check the rules for "), F.substring_index("finding_id", "/", -1)),
        ).alias("hypotheses"),
        F.concat(F.lit("cites "), F.col("n").cast("string")).alias("confidence_reason"),
    )


def english(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").filter(condition("lang", "eq", "en"))
    return documents.select(F.col("doc_id").cast("string").alias("record_id"))


_CITED_SQL = """
cited AS (
  SELECT d.source || '/' || d.lang AS finding_id, CASE WHEN l.toxic = 1 THEN 'supporting' ELSE 'counter' END AS evidence_type,
    l.doc_id AS position, CAST(l.doc_id AS VARCHAR) AS record_id, d.lang <> 'en' AS outside
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
headers AS (
  SELECT finding_id, 'root_cause_pattern' AS finding_type, 'Toxic text in ' || finding_id AS claim,
    CASE WHEN count(*) >= 10 THEN 'high' WHEN count(*) <= 2 THEN 'low' ELSE 'medium' END AS confidence,
    'cites ' || count(*) AS confidence_reason,
    count(*) FILTER (evidence_type = 'supporting') AS n_supporting, count(*) FILTER (evidence_type = 'counter') AS n_counter,
    count(*) FILTER (evidence_type = 'supporting' AND outside) AS supporting_outside,
    count(*) FILTER (evidence_type = 'counter' AND outside) AS counter_outside
  FROM cited GROUP BY finding_id)
"""
_VALIDATED_SQL = _CITED_SQL + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY finding_id, evidence_type ORDER BY position) AS rn FROM cited WHERE outside),
shown AS (
  SELECT finding_id, evidence_type, string_agg('''' || record_id || '''', ', ' ORDER BY rn) AS ids FROM ranked WHERE rn <= 3
  GROUP BY finding_id, evidence_type),
validated AS (
  SELECT h.*, concat_ws(' | ',
    CASE WHEN n_supporting = 0 THEN 'Finding lacks supporting records.' END,
    CASE WHEN supporting_outside > 0 THEN 'Supporting records not found in candidate set: [' || s.ids || '] (total missing: ' || supporting_outside || ')' END,
    CASE WHEN counter_outside > 0 THEN 'Counter records not found in candidate set: [' || c.ids || '] (total missing: ' || counter_outside || ')' END
    ) AS reasons,
    n_supporting > 0 AND supporting_outside = 0 AND counter_outside = 0 AS accepted
  FROM headers h LEFT JOIN shown s ON h.finding_id = s.finding_id AND s.evidence_type = 'supporting'
    LEFT JOIN shown c ON h.finding_id = c.finding_id AND c.evidence_type = 'counter')
"""


def _validated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    cited = cited_labels(spark, folder)
    return ev.validate_findings(headers_of(cited), cited, english(spark, folder)), cited


@query("validate_findings", f"""WITH {_VALIDATED_SQL}
SELECT finding_id, confidence, n_supporting, n_counter, supporting_outside, counter_outside, reasons, accepted FROM validated
""")
def validate_findings(spark: SparkSession, folder: str) -> DataFrame:
    validated, _ = _validated(spark, folder)
    return validated.select(
        "finding_id", "confidence", "n_supporting", "n_counter", "supporting_outside", "counter_outside",
        F.array_join("reasons", " | ").alias("reasons"), "accepted",
    )


_SUBMITTED_SQL = """
WITH d AS (SELECT conv_id, turn, role, 'conv' || conv_id || '/' || turn AS doc FROM conversations),
items AS (
  SELECT doc, 1 AS position, 'FIND-001' AS finding_id, [CAST(turn AS VARCHAR)] AS ids, role FROM d
  UNION ALL SELECT doc, 2, CASE WHEN role = 'user' THEN 'FIND-001' ELSE 'FIND-002' END, ['0', CAST(turn + 1 AS VARCHAR)], role FROM d),
cited AS (SELECT doc || '/' || position AS finding_key, unnest(ids) AS record_id FROM items)
SELECT doc || '/' || position AS finding_key, finding_id, len(ids) AS n_supporting, o.n AS supporting_outside, o.n = 0 AS accepted, position AS n_batches
FROM items JOIN (
  SELECT finding_key, count(*) FILTER (CAST(record_id AS BIGINT) NOT IN (SELECT turn FROM conversations WHERE role = 'user')) AS n
  FROM cited GROUP BY finding_key) o ON o.finding_key = doc || '/' || position
"""


def _submitted(spark: SparkSession, folder: str) -> DataFrame:
    """A findings document per turn; ids are missing or the same in all of them."""
    turns = table(spark, folder, "conversations")
    turn = F.col("turn").cast("string")
    first = F.struct(F.lit("one").alias("claim"), F.array(turn).alias("supporting_records"), F.array(F.lit("batch-001")).alias("derived_batch_ids"))
    second = F.struct(
        F.when(F.col("role") == "user", "FIND-001").alias("finding_id"), F.lit("two").alias("claim"),
        F.array(F.lit("0"), (F.col("turn") + 1).cast("string")).alias("supporting_records"),
        F.array(F.lit("batch-001"), F.lit("batch-002")).alias("derived_batch_ids"))
    documents = turns.select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit("/"), turn).alias("doc"),
        F.concat(F.lit("["), F.to_json(first), F.lit(","), F.to_json(second), F.lit("]")).alias("json"))
    return parse_findings(documents, "json", keep=["doc"])

@query("validate_many_documents", _SUBMITTED_SQL)
def validate_many_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Findings whose ids repeat over documents, each judged alone."""
    parsed = _submitted(spark, folder)
    candidates = table(spark, folder, "conversations").filter(condition("role", "eq", "user")).select(F.col("turn").cast("string").alias("record_id")).distinct()
    validated = ev.validate_findings(parsed.drop("supporting_records", "counter_records"), ev.cited_records(parsed), candidates)
    return validated.select("finding_key", "finding_id", "n_supporting", "supporting_outside", "accepted", F.size("derived_batch_ids").alias("n_batches"))


@query("finding_batches", """
WITH d AS (SELECT turn, 'conv' || conv_id || '/' || turn AS doc FROM conversations)
SELECT doc || '/1' AS finding_key, CAST(1 AS BIGINT) AS n_supporting, CAST(turn AS VARCHAR) AS first_supporting, 'batch-001' AS derived_batches FROM d
UNION ALL SELECT doc || '/2', 2, '0, ' || (turn + 1), 'batch-001, batch-002' FROM d
""")
def finding_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries that name the batches each finding was derived from."""
    parsed = _submitted(spark, folder)
    headers = parsed.drop("supporting_records", "counter_records")
    summary = ev.finding_summary(headers, ev.cited_records(parsed))
    return summary.select("finding_key", "n_supporting", "first_supporting", "derived_batches")


@query("finding_totals", f"""WITH {_VALIDATED_SQL}
SELECT count(*) AS total_submitted, count(*) FILTER (accepted) AS accepted_count, count(*) FILTER (NOT accepted) AS rejected_count FROM validated
""")
def finding_totals(spark: SparkSession, folder: str) -> DataFrame:
    return ev.finding_totals(_validated(spark, folder)[0])


@query("evidence_index", f"""WITH {_VALIDATED_SQL}
SELECT record_id, finding_id, max(evidence_type = 'supporting') AS is_supporting, max(evidence_type = 'counter') AS is_counter
FROM cited WHERE finding_id IN (SELECT finding_id FROM validated WHERE accepted) GROUP BY record_id, finding_id
""")
def evidence_index(spark: SparkSession, folder: str) -> DataFrame:
    return ev.evidence_index(ev.accepted_citations(*_validated(spark, folder)))


def _order_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Findings that overlap: all orders by status and by priority, urgent ones in support."""
    return table(spark, folder, "orders").select(
        F.explode(F.array("o_orderstatus", "o_orderpriority")).alias("finding_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "supporting").otherwise("counter").alias("evidence_type"),
        F.col("o_orderkey").alias("position"),
        F.col("o_orderkey").cast("string").alias("record_id"),
    )


@query("evidence_records", """
SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CAST(2 AS BIGINT) AS n_findings FROM orders
""")
def evidence_records(spark: SparkSession, folder: str) -> DataFrame:
    """Each cited record once; every order is in two findings."""
    return ev.evidence_records(ev.evidence_index(_order_citations(spark, folder)))


_APPENDIX_COLUMNS = {
    "o_orderkey": False, "o_custkey": False, "o_orderstatus": False, "o_totalprice": False, "o_orderdate": False, "o_orderpriority": True,
}


@query("evidence_appendix", " UNION ALL ".join(f"""
SELECT CAST(o_orderkey AS VARCHAR) AS record_id, 'orders' AS source_file, o_orderkey AS row_idx, CAST(2 AS BIGINT) AS n_findings,
  '{c}' AS column_id, CAST({c} AS VARCHAR) AS raw_value, {"o_orderpriority" if mapped else "'-'"} AS normalized_value
FROM orders""" for c, mapped in _APPENDIX_COLUMNS.items()))
def evidence_appendix(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_view(table(spark, folder, "orders"), "o_orderkey", list(_APPENDIX_COLUMNS), "orders", "o_orderkey")
    normalised = orders_by_priority(spark, folder).withColumn("record_id", F.col("o_orderkey").cast("string"))
    records = ev.evidence_records(ev.evidence_index(_order_citations(spark, folder)))
    return ev.evidence_appendix(raw, normalised, records, _APPENDIX_COLUMNS)


@query("insight_evidence", f"""WITH {_CITED_SQL}
SELECT c.finding_id, h.finding_type, c.evidence_type, c.record_id, h.claim FROM cited c JOIN headers h ON c.finding_id = h.finding_id
""")
def insight_evidence(spark: SparkSession, folder: str) -> DataFrame:
    cited = cited_labels(spark, folder)
    return ev.insight_evidence(headers_of(cited), cited)


@query("counter_evidence", f"WITH {_CITED_SQL} SELECT finding_id, record_id FROM cited WHERE evidence_type = 'counter'")
def counter_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return ev.counter_evidence(cited_labels(spark, folder))


@query("finding_summary", f"""WITH {_CITED_SQL}, first AS (
  SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY position) AS rn FROM cited WHERE evidence_type = 'supporting'),
heads AS (SELECT finding_id, string_agg(record_id, ', ' ORDER BY rn) AS ids FROM first WHERE rn <= 5 GROUP BY finding_id)
SELECT h.finding_id, finding_type, claim, confidence, confidence_reason, n_supporting, n_counter, 2 AS n_hypotheses,
  coalesce(ids, '') AS first_supporting, n_supporting > 5 AS has_more
FROM headers h LEFT JOIN heads ON h.finding_id = heads.finding_id
""")
def finding_summary(spark: SparkSession, folder: str) -> DataFrame:
    cited = cited_labels(spark, folder)
    return ev.finding_summary(headers_of(cited), cited)


@query("finding_hypotheses", f"""WITH {_CITED_SQL}
SELECT finding_id, 1 AS position, 'check the feed of ' || split_part(finding_id, '/', 1) AS hypothesis FROM headers
UNION ALL SELECT finding_id, 2, 'check the rules for ' || split_part(finding_id, '/', 2) FROM headers
""")
def finding_hypotheses(spark: SparkSession, folder: str) -> DataFrame:
    return ev.finding_hypotheses(headers_of(cited_labels(spark, folder)))


@query("findings_defaults", """
SELECT c.conv_id, c.turn, printf('FIND-%03d', 1) AS finding_id, CASE WHEN role = 'user' THEN 'root_cause_pattern' ELSE role END AS finding_type,
  text AS claim, CASE WHEN role = 'user' THEN 'high' ELSE 'medium' END AS confidence,
  'Supported by deterministic candidate records' AS confidence_reason
FROM conversations c
UNION ALL
SELECT c.conv_id, c.turn, 'T' || turn, 'reply', '', 'medium', role FROM conversations c
""")
def findings_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn as a small findings document, read back with the gaps filled."""
    blank = F.lit(None).cast("string")
    user = F.col("role") == "user"
    first = F.struct(
        blank.alias("finding_id"), F.when(~user, F.col("role")).alias("type"), F.col("text").alias("claim"),
        F.when(user, "high").otherwise("certain").alias("confidence"),
    )
    second = F.struct(
        F.concat(F.lit("T"), F.col("turn").cast("string")).alias("finding_id"), F.lit("reply").alias("finding_type"),
        F.col("role").alias("confidence_reason"),
    )
    turns = table(spark, folder, "conversations")
    items = F.concat_ws(",", F.to_json(first), F.to_json(second))
    document = F.when(user, F.concat(F.lit("["), items, F.lit("]"))).otherwise(F.concat(F.lit('{"findings":['), items, F.lit("]}")))
    parsed = parse_findings(turns.select("conv_id", "turn", document.alias("json")), "json", keep=["conv_id", "turn"])
    return parsed.select("conv_id", "turn", "finding_id", "finding_type", "claim", "confidence", "confidence_reason")


@query("feedback_to_lessons", """
WITH n AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) + 7 AS n FROM conversations WHERE role = 'user')
SELECT printf('LES-%04d', n) AS lesson_id, printf('FB-%04d', n) AS feedback_id, 'RUN-' || conv_id AS run_id,
  'analysis_feedback' AS lesson_type, text AS user_feedback, 'Consider: ' || text AS derived_lesson, 'candidate' AS status FROM n
""")
def feedback_to_lessons(spark: SparkSession, folder: str) -> DataFrame:
    """User turns as feedback to a ledger that already holds seven lessons."""
    turns = table(spark, folder, "conversations").filter(condition("role", "eq", "user"))
    feedback = turns.select(
        "conv_id", "turn",
        F.concat(F.lit("RUN-"), F.col("conv_id").cast("string")).alias("run_id"),
        F.lit("analysis_feedback").alias("lesson_type"),
        F.col("text").alias("user_feedback"),
        F.concat(F.lit("Consider: "), F.col("text")).alias("derived_lesson"),
        F.create_map().cast("map<string,string>").alias("scope"),
    )
    return le.record_feedback(feedback, ["conv_id", "turn"], ledger_size=7).drop("scope")


@query("ledger_appends", """
WITH n AS (SELECT *, row_number() OVER (ORDER BY conv_id % 2, conv_id, turn) AS n FROM conversations WHERE role = 'user')
SELECT printf('LES-%04d', n) AS lesson_id, printf('FB-%04d', n) AS feedback_id, 'RUN-' || conv_id AS run_id, text AS user_feedback,
  'conversations ' || (conv_id % 2) AS batch_key, 'candidate' AS status FROM n
""")
def ledger_appends(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches of user turns appended to a stored ledger, the second one twice."""
    turns = table(spark, folder, "conversations").filter(condition("role", "eq", "user"))
    path = scratch_path(spark, "ledger")
    ledger = le.read_ledger(spark, path)
    for half in (0, 1, 1):
        feedback = turns.filter(F.col("conv_id") % 2 == half).select(
            "conv_id", "turn", F.concat(F.lit("RUN-"), F.col("conv_id").cast("string")).alias("run_id"),
            F.lit("analysis_feedback").alias("lesson_type"), F.col("text").alias("user_feedback"),
            F.concat(F.lit("Consider: "), F.col("text")).alias("derived_lesson"), F.create_map().cast("map<string,string>").alias("scope"))
        ledger = le.append_feedback(feedback, ["conv_id", "turn"], path, f"conversations {half}")
    return ledger.select("lesson_id", "feedback_id", "run_id", "user_feedback", "batch_key", "status")


def _lessons(spark: SparkSession, folder: str) -> DataFrame:
    """A lesson per label; Spanish ones have no scope, bad labels are rejected."""
    documents = table(spark, folder, "documents").select("doc_id", "lang")
    return table(spark, folder, "labels").join(documents, "doc_id").select(
        F.col("doc_id").alias("lesson_id"),
        F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "accepted").otherwise("draft").alias("status"),
        F.when(F.col("lang") != "es", F.create_map(F.lit("analysis_type"), F.col("lang"))).alias("scope"),
    )


_LESSON_SQL = """
SELECT l.doc_id AS lesson_id, CASE WHEN quality = 1 THEN 'accepted' ELSE 'candidate' END AS status, quality = 1 AS is_accepted
FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE toxic <> 1 AND lang IN ('en', 'es')
"""


@query("applicable_lessons", _LESSON_SQL)
def applicable_lessons(spark: SparkSession, folder: str) -> DataFrame:
    return le.applicable_lessons(_lessons(spark, folder), "en").drop("scope")


@query("applicable_lessons_accepted", f"SELECT * FROM ({_LESSON_SQL}) WHERE is_accepted")
def applicable_lessons_accepted(spark: SparkSession, folder: str) -> DataFrame:
    return le.applicable_lessons(_lessons(spark, folder), "en", only_accepted=True).drop("scope")


@query("number_rows", "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS n FROM customer")
def numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Global numbers in an order led by a column of few values."""
    return number_rows(table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment", "c_custkey"], "n").drop("c_mktsegment")
