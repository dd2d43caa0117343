"""Both phases end to end over the documents as a register."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.plans import analysis, build
from rollbook.queries.findings import cited_labels, headers_of
from rollbook.queries.registry import query, table
from rollbook.queries.retrieval import EXPANDED, PRIMARY, SEARCH_SQL
from rollbook.session import scratch_path
from rollbook.sources.register import raw_view
from rollbook.sources.sinks import write_table

_COLUMNS = ["doc_id", "text", "lang", "source"]
_HITS = f"SELECT * FROM documents WHERE lang IN ('en', 'fr') AND {SEARCH_SQL}"


def _register(spark: SparkSession, folder: str) -> build.Register:
    raw = raw_view(table(spark, folder, "documents"), "doc_id", _COLUMNS, "documents", "doc_id")
    path = scratch_path(spark, "documents-register")
    proposal = build.propose(raw, f"{path}/proposal", "doc_id")
    return build.finalise(raw, proposal, f"{path}/register", accept_pending=True, index=False, exports=False)


def _answer(register: build.Register) -> analysis.Analysis:
    search = analysis.Search(PRIMARY, EXPANDED, ["text"])
    return analysis.analyse(register, [("lang", "in", ["en", "fr"])], search, projection=["text", "lang", "source"])


@query("register_question", f"""
WITH hits AS ({_HITS})
SELECT 'lang' AS dimension, lang AS category, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM hits), 2) AS percentage
FROM hits GROUP BY lang
UNION ALL
SELECT 'source', source, count(*), round(count(*) * 100.0 / (SELECT count(*) FROM hits), 2) FROM hits GROUP BY source
""")
def register_question(spark: SparkSession, folder: str) -> DataFrame:
    """Propose, finalise, analyse: the distributions of the candidates."""
    return _answer(_register(spark, folder)).distributions


_STATES = ("pending", "accepted", "edited")
_URGENT_IDS = {"pending": "1-URGENT", "accepted": "val_1-urgent", "edited": "sev_top"}


def _orders_register(spark: SparkSession, folder: str, state: str = "accepted") -> build.Register:
    """Orders as a register: priorities as severity, status as type, with the value map left, accepted or edited."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("severity"), F.col("o_orderstatus").alias("defect_type"),
        F.col("o_orderpriority").alias("component"), F.col("o_orderdate").cast("date").cast("string").alias("detect_date"))
    raw = raw_view(orders, "o_orderkey", ["o_orderkey", "severity", "defect_type", "component", "detect_date"], "orders", "o_orderkey")
    path = scratch_path(spark, "orders-register")
    proposal = build.propose(raw, f"{path}/proposal", "o_orderkey")
    if state == "edited":
        top = (F.col("column_id") == "severity") & (F.col("raw_value") == "1-URGENT")
        proposal.mappings = proposal.mappings.withColumns({
            "canonical_id": F.when(top, "sev_top").otherwise(F.col("canonical_id")),
            "canonical_label": F.when(top, "Top").otherwise(F.col("canonical_label")),
            "status": F.when(top, "accepted").otherwise(F.col("status"))})
    return build.finalise(raw, proposal, f"{path}/register", accept_pending=state == "accepted", exports=False)


@query("filter_mapped_category", " UNION ALL ".join(f"""
SELECT '{state}' AS state, '{name}' AS filter, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders WHERE {where}"""
    for state in _STATES for name, where in (
        ("eq", "o_orderpriority = '1-URGENT'"), ("neq", "o_orderpriority <> '1-URGENT'"),
        ("in", "o_orderpriority IN ('1-URGENT', '5-LOW')"), ("not_in", "o_orderpriority NOT IN ('1-URGENT', '5-LOW')"),
        ("id", "o_orderpriority = '1-URGENT'"))))
def filter_mapped_category(spark: SparkSession, folder: str) -> DataFrame:
    """Category filters mean the same whether the value map is pending, accepted or edited."""
    out = []
    for state in _STATES:
        register = _orders_register(spark, folder, state)
        for name, operator, value in (
            ("eq", "eq", "1-urgent"), ("neq", "neq", "1-URGENT"), ("in", "in", ["1-URGENT", "5-LOW"]),
            ("not_in", "not_in", ["1-URGENT", "5-LOW"]), ("id", "eq", _URGENT_IDS[state]),
        ):
            value = "1-URGENT" if state == "pending" and name == "eq" else value
            hits = register.normalised.filter(analysis.filter_column(register, "severity", operator, value))
            key = F.col("record_id").cast("long")
            out.append(hits.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last")).select(
                F.lit(state).alias("state"), F.lit(name).alias("filter"), "n", "first", "last"))
    return reduce(DataFrame.unionByName, out)


_BOUNDS = (
    ("eq", "eq", "urgent", "o_orderpriority = '1-URGENT'"), ("neq", "neq", "1-URGENT", "o_orderpriority <> '1-URGENT'"),
    ("in", "in", ["URGENT", "5-low"], "o_orderpriority IN ('1-URGENT', '5-LOW')"),
    ("not_in", "not_in", ["pri_1", "5-LOW"], "o_orderpriority NOT IN ('1-URGENT', '5-LOW')"),
    ("gte", "gte", "medium", "o_orderpriority >= '3-MEDIUM'"), ("lt", "lt", 30, "o_orderpriority < '3-MEDIUM'"),
    ("between", "between", ["2-high", "pri_4"], "o_orderpriority BETWEEN '2-HIGH' AND '4-NOT SPECIFIED'"),
)


@query("filter_table_dictionary", " UNION ALL ".join(
    f"SELECT '{name}' AS filter, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders WHERE {where}"
    for name, _, _, where in _BOUNDS))
def filter_table_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Category and ordinal filters on a register whose dictionary is a table, made from the orders."""
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("detect_phase"))
    place = F.substring("detect_phase", 1, 1)
    dictionary = orders.select("detect_phase").distinct().select(
        F.concat(F.lit("pri_"), place).alias("canonical_id"), F.col("detect_phase").alias("label"), (place.cast("int") * 10).alias("ordinal"),
        F.array(F.lower(F.substring("detect_phase", 3, 99))).alias("aliases"))
    path = scratch_path(spark, "dictionary-register")
    dictionary = write_table(dictionary, f"{path}/dictionary")
    raw = raw_view(orders, "o_orderkey", ["o_orderkey", "detect_phase"], "orders", "o_orderkey")
    proposal = build.propose(raw, f"{path}/proposal", "o_orderkey", dictionary)
    register = build.finalise(raw, proposal, f"{path}/register", dictionary=dictionary, exports=False)
    key = F.col("record_id").cast("long")
    return reduce(DataFrame.unionByName, [
        register.normalised.filter(analysis.filter_column(register, "detect_phase", operator, value))
        .agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last")).select(F.lit(name).alias("filter"), "n", "first", "last")
        for name, operator, value, _ in _BOUNDS])


@query("register_tables", """
WITH hits AS (SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW'))
SELECT 'component_x_defect_type' AS name, o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM hits GROUP BY ALL
UNION ALL SELECT 'detect_date', strftime(o_orderdate, '%Y-%m'), '', count(*) FROM hits GROUP BY ALL
UNION ALL SELECT 'trace', CAST((SELECT count(*) FROM hits) AS VARCHAR), 'SQL_ONLY', count(*) FROM hits
""")
def register_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Cross-tabs, trend and trace of one question, all from its stored hits."""
    register = _orders_register(spark, folder)
    answer = analysis.analyse(register, [("severity", "in", ["1-URGENT", "2-HIGH", "5-LOW"])], projection=["severity"])
    tabs = answer.cross_tabs.select(F.col("pair").alias("name"), F.col("row_value").alias("a"), F.col("column_value").alias("b"), F.col("count").alias("n"))
    trends = answer.trends.select(F.col("dimension").alias("name"), F.col("year_month").alias("a"), F.lit("").alias("b"), F.col("count").alias("n"))
    trace = answer.trace.select(
        F.lit("trace").alias("name"), F.col("sql_matched_count").cast("string").alias("a"), F.col("set_operation").alias("b"),
        F.col("final_candidate_count").alias("n"))
    return tabs.filter("name = 'component_x_defect_type'").unionByName(trends).unionByName(trace)


@query("register_evidence", f"""
WITH cited AS (SELECT d.source || '/' || d.lang AS finding_id, l.toxic, d.* FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
accepted AS (
  SELECT finding_id FROM cited GROUP BY finding_id
  HAVING count(*) FILTER (toxic = 1) > 0 AND count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM ({_HITS}))) = 0),
kept AS (SELECT * FROM cited WHERE finding_id IN (SELECT finding_id FROM accepted))
SELECT CAST(doc_id AS VARCHAR) AS record_id, 'documents' AS source_file, doc_id AS row_idx, CAST(1 AS BIGINT) AS n_findings,
  column_id, raw_value, normalized_value
FROM (
  SELECT doc_id, 'doc_id' AS column_id, CAST(doc_id AS VARCHAR) AS raw_value, '-' AS normalized_value FROM kept
  UNION ALL SELECT doc_id, 'text', replace(text, chr(10), '<br>'), '-' FROM kept
  UNION ALL SELECT doc_id, 'lang', lang, lang FROM kept
  UNION ALL SELECT doc_id, 'source', source, source FROM kept)
""")
def register_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The whole way to the evidence appendix: whole raw texts of every record an accepted finding cites."""
    register = _register(spark, folder)
    answer = _answer(register)
    cited = cited_labels(spark, folder)
    statuses = answer.batches.select("batch_index", F.lit("completed").alias("status"))
    done = analysis.complete(register, answer, headers_of(cited), cited, statuses, scratch_path(spark, "documents-report"))
    return done["appendix"]
