"""Batch packing and coverage over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.predicates import condition
from rollbook.operators import packing
from rollbook.operators.selection import candidate_ids, fetch_records
from rollbook.queries.registry import query, table
from rollbook.session import materialise

_PROJECTION = ["doc_id", "text", "lang", "source"]
_SIZE_SQL = "length(CAST(doc_id AS VARCHAR)) + length(text) + length(lang) + length(source) + 50"

# Sequential next-fit as a recursive walk over the rows in order.
_PACK_SQL = """
sized AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rn FROM ({rows})),
walk AS (
  SELECT rn, size, size AS used, 1 AS batch FROM sized WHERE rn = 1
  UNION ALL
  SELECT s.rn, s.size, CASE WHEN w.used + s.size > 12000 THEN s.size ELSE w.used + s.size END,
    CASE WHEN w.used + s.size > 12000 THEN w.batch + 1 ELSE w.batch END
  FROM walk w JOIN sized s ON s.rn = w.rn + 1),
packed AS (
  SELECT s.*, w.batch AS batch_index, max(w.batch) OVER () AS total_batches FROM walk w JOIN sized s ON s.rn = w.rn)
"""


def _pack_sql(rows: str, order: str) -> str:
    return "WITH RECURSIVE " + _PACK_SQL.format(rows=rows, order=order)


_DOCUMENTS_SQL = _pack_sql(f"SELECT doc_id, {_SIZE_SQL} AS size FROM documents", "doc_id")
_ENGLISH_SQL = _pack_sql(f"SELECT doc_id, {_SIZE_SQL} AS size FROM documents WHERE lang = 'en'", "doc_id")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the id both as record id and as source row number."""
    return table(spark, folder, "documents").withColumn("row_idx", F.col("doc_id"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_batches(_documents(spark, folder), "doc_id", "row_idx", _PROJECTION)


@query("record_chars", f"SELECT doc_id, CAST({_SIZE_SQL} AS BIGINT) AS rec_chars FROM documents")
def record_chars(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", packing.record_chars(_PROJECTION).alias("rec_chars"))


@query("pack_batches", f"""{_DOCUMENTS_SQL}
SELECT doc_id, doc_id AS position, CAST(size AS BIGINT) AS rec_chars, CAST(batch_index AS BIGINT) AS batch_index,
  CAST(total_batches AS BIGINT) AS total_batches FROM packed
""")
def pack_batches(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


@query("pack_candidate_batches", f"""{_ENGLISH_SQL}
SELECT doc_id, CAST(batch_index AS BIGINT) AS batch_index, CAST(total_batches AS BIGINT) AS total_batches FROM packed
""")
def pack_candidate_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Packing of a candidate set, with gaps in the row numbers and small blocks."""
    documents = _documents(spark, folder)
    ids = candidate_ids(documents, "doc_id", condition("lang", "eq", "en"))
    records = fetch_records(documents, ids, "doc_id", [*_PROJECTION, "row_idx"])
    packed = packing.pack_batches(records, "doc_id", "row_idx", _PROJECTION, block_rows=64, fan_in=8)
    return packed.select("doc_id", "batch_index", "total_batches")


@query("batch_summary", f"""{_DOCUMENTS_SQL}
SELECT printf('batch-%03d', batch_index) AS batch_id, CAST(batch_index AS BIGINT) AS batch_index,
  CAST(max(total_batches) AS BIGINT) AS total_batches, count(*) AS record_count, CAST(sum(size - 50) AS BIGINT) AS estimated_chars,
  'pending' AS status, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS record_ids
FROM packed GROUP BY batch_index
""")
def batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = packing.batch_summary(_packed(spark, folder), "doc_id")
    return summary.withColumn("record_ids", F.array_join("record_ids", ","))


_HASH_SQL = "('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12))::BIGINT"
_SPARSE_SQL = _pack_sql(f"SELECT doc_id, {_HASH_SQL} AS place, {_SIZE_SQL} AS size FROM documents", "place, doc_id")


@query("pack_sparse", f"""{_SPARSE_SQL}
SELECT doc_id, place AS position, CAST(size AS BIGINT) AS rec_chars, CAST(batch_index AS BIGINT) AS batch_index,
  CAST(total_batches AS BIGINT) AS total_batches FROM packed
""")
def pack_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """Packing in the order of a hash, whose values lie far apart."""
    place = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 12), 16, 10).cast("long")
    return packing.pack_batches(table(spark, folder, "documents").withColumn("place", place), "doc_id", "place", _PROJECTION)


def _statuses(summary: DataFrame) -> DataFrame:
    """A review outcome per batch: long single records fail, crowded batches wait, the rest is done."""
    return summary.select(
        "batch_index",
        F.when(F.col("estimated_chars") > 12000, "failed").when(F.col("record_count") >= 8, "pending")
        .otherwise("completed").alias("status"),
    )


_SOURCE_SQL = _pack_sql(f"SELECT doc_id, source, {_SIZE_SQL} AS size FROM documents", "source, doc_id")


@query("pack_batches_by_source", f"""{_SOURCE_SQL}
SELECT doc_id, CAST(rn AS BIGINT) AS position, CAST(size AS BIGINT) AS rec_chars, CAST(batch_index AS BIGINT) AS batch_index,
  CAST(total_batches AS BIGINT) AS total_batches FROM packed
""")
def pack_batches_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Packing in an order of two columns, as for a register of many files."""
    return packing.pack_batches(table(spark, folder, "documents"), "doc_id", ["source", "doc_id"], _PROJECTION)


_STATUS_SQL = """
batches AS (SELECT batch_index, sum(size - 50) AS chars, count(*) AS n FROM packed GROUP BY batch_index),
statuses AS (SELECT batch_index, CASE WHEN chars > 12000 THEN 'failed' WHEN n >= 8 THEN 'pending' ELSE 'completed' END AS status FROM batches),
reviewed AS (SELECT p.doc_id, s.status FROM packed p JOIN statuses s USING (batch_index))
"""


@query("coverage", f"""{_DOCUMENTS_SQL}, {_STATUS_SQL}
SELECT count(*) AS total_candidates, count(*) FILTER (status = 'completed') AS evaluated_count,
  count(*) FILTER (status = 'failed') AS failed_count, count(*) FILTER (status = 'pending') AS skipped_count, CAST(0 AS BIGINT) AS outside_candidates,
  round(count(*) FILTER (status = 'completed') * 100.0 / count(*), 2) AS coverage_percentage,
  count(*) FILTER (status <> 'completed') = 0 AS is_100_percent_covered
FROM reviewed
""")
def coverage(spark: SparkSession, folder: str) -> DataFrame:
    packed = materialise(_packed(spark, folder), "packed")
    statuses = _statuses(packing.batch_summary(packed, "doc_id"))
    return packing.coverage(table(spark, folder, "documents").select("doc_id"), packed, statuses, "doc_id")


@query("coverage_outside", f"""{_DOCUMENTS_SQL}, {_STATUS_SQL}, c AS (SELECT doc_id FROM documents WHERE lang = 'en')
SELECT (SELECT count(*) FROM c) AS total_candidates, count(*) FILTER (status = 'completed') AS evaluated_count,
  count(*) FILTER (status = 'failed') AS failed_count,
  count(*) FILTER (status = 'pending' AND doc_id IN (SELECT doc_id FROM c)) AS skipped_count,
  count(*) FILTER (status <> 'pending' AND doc_id NOT IN (SELECT doc_id FROM c)) AS outside_candidates,
  round(count(*) FILTER (status = 'completed') * 100.0 / (SELECT count(*) FROM c), 2) AS coverage_percentage,
  FALSE AS is_100_percent_covered
FROM reviewed
""")
def coverage_outside(spark: SparkSession, folder: str) -> DataFrame:
    """Batches hold more than the candidates: counts stay as the batches list them, the excess is shown."""
    packed = materialise(_packed(spark, folder), "packed")
    statuses = _statuses(packing.batch_summary(packed, "doc_id"))
    candidates = candidate_ids(table(spark, folder, "documents"), "doc_id", condition("lang", "eq", "en"))
    return packing.coverage(candidates, packed, statuses, "doc_id")
