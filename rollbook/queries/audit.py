"""Data-quality audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators import quality as q
from rollbook.queries.registry import query, table

_WORDS = ["ther", "tion", "eaux"]
_WORD_SQL = "(contains(text, 'ther') OR contains(text, 'tion') OR contains(text, 'eaux'))"
_DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def _column_sql(table_name: str, column: str, text: bool) -> str:
    filled = f"CASE WHEN v <> '' THEN length(v) END" if text else "CAST(NULL AS BIGINT)"
    return f"""SELECT '{column}' AS column_id, count(*) AS total_records, count(*) FILTER (v IS NULL OR v = '') AS null_count,
  round(count(*) FILTER (v IS NULL OR v = '') * 100.0 / count(*), 2) AS null_percentage, count(DISTINCT v) AS distinct_count,
  coalesce(min({filled}), 0) AS min_len, coalesce(max({filled}), 0) AS max_len, coalesce(round(avg({filled}), 1), 0.0) AS avg_len
FROM (SELECT CAST({column} AS VARCHAR) AS v FROM {table_name})"""


def _columns_sql(table_name: str, columns: list[str], text: list[str]) -> str:
    return " UNION ALL ".join(_column_sql(table_name, c, c in text) for c in columns)


@query("audit_columns", _columns_sql("documents", _DOCUMENT_COLUMNS, ["text"]))
def audit_columns(spark: SparkSession, folder: str) -> DataFrame:
    return q.audit_columns(table(spark, folder, "documents"), _DOCUMENT_COLUMNS, ["text"])


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query("approx_distinct", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, '{c}' AS column_id, count(DISTINCT {c}) AS exact, true AS near, true AS merges FROM {name}"
    for name, columns in (("orders", _ORDER_COLUMNS), ("documents", _DOCUMENT_COLUMNS)) for c in columns))
def approx_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct counts from merged sketches beside the exact ones: within two percent, however the rows were parted."""
    out = []
    for name, columns, part in (("orders", _ORDER_COLUMNS, "o_orderkey"), ("documents", _DOCUMENT_COLUMNS, "doc_id")):
        df = table(spark, folder, name)
        halves = q.approximate_distinct(q.distinct_sketches(df, columns, F.col(part) % 2)).withColumnRenamed("distinct_count", "halves")
        whole = q.approximate_distinct(q.distinct_sketches(df, columns)).withColumnRenamed("distinct_count", "whole")
        exact = q.audit_columns(df, columns).select("column_id", F.col("distinct_count").alias("exact"))
        both = exact.join(halves, "column_id").join(whole, "column_id")
        near = F.abs(F.col("halves") - F.col("exact")) <= 0.02 * F.col("exact")
        out.append(both.select(
            F.lit(name).alias("table_name"), "column_id", "exact", near.alias("near"), (F.col("halves") == F.col("whole")).alias("merges")))
    return out[0].unionByName(out[1])


@query("audit_columns_part", _columns_sql("part", _PART_COLUMNS, ["p_name"]))
def audit_columns_part(spark: SparkSession, folder: str) -> DataFrame:
    return q.audit_columns(table(spark, folder, "part"), _PART_COLUMNS, ["p_name"])


@query("audit_columns_with_null", _columns_sql(
    "(SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)", ["doc_id", "quality", "toxic"], []))
def audit_columns_with_null(spark: SparkSession, folder: str) -> DataFrame:
    labelled = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    return q.audit_columns(labelled, ["doc_id", "quality", "toxic"])


@query("audit_text_length", f"""
SELECT column_id, min_len, max_len, avg_len FROM ({_columns_sql('conversations', ['role', 'text'], ['role', 'text'])})
""")
def audit_text_length(spark: SparkSession, folder: str) -> DataFrame:
    audit = q.audit_columns(table(spark, folder, "conversations"), ["role", "text"], ["role", "text"])
    return audit.select("column_id", "min_len", "max_len", "avg_len")


@query("audit_identical_fields", """
SELECT count(*) AS total_records, count(*) FILTER (o_orderstatus = l_linestatus AND o_orderstatus <> '') AS identical
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def audit_identical_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose status equals their order's.  Lines are counted per order and status before the join."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    same = q.identical_fields("o_orderstatus", "l_linestatus")
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        F.coalesce(F.sum(F.when(same, F.col("n"))), F.lit(0)).alias("identical"),
    )


@query("audit_keywords", f"SELECT count(*) AS total_records, count(*) FILTER ({_WORD_SQL}) AS superficial FROM documents")
def audit_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return q.count_rows(table(spark, folder, "documents"), superficial=q.superficial("text", _WORDS))


_MEASURES = ["total_records", "null_count", "null_percentage", "distinct_count", "min_len", "max_len", "avg_len"]


@query("audit_summary", f"""
WITH measured AS ({_columns_sql('documents', _DOCUMENT_COLUMNS, ['text'])})
{' UNION ALL '.join(f"SELECT column_id AS subject, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM measured" for m in _MEASURES)}
UNION ALL SELECT 'superficial', 'count', CAST(count(*) FILTER ({_WORD_SQL}) AS DOUBLE) FROM documents
UNION ALL SELECT 'identical', 'count', CAST(count(*) FILTER (lang = source AND lang <> '') AS DOUBLE) FROM documents
""")
def audit_summary(spark: SparkSession, folder: str) -> DataFrame:
    return q.audit_summary(
        table(spark, folder, "documents"), _DOCUMENT_COLUMNS, ["text"],
        {"superficial": q.superficial("text", _WORDS), "identical": q.identical_fields("lang", "source")},
    )
