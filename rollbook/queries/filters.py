"""One query per filter predicate."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.predicates import all_of, condition
from rollbook.operators.normalization import (
    apply_mappings,
    canonical_literal,
    dictionary_mappings,
    ordinal_condition,
)
from rollbook.operators.selection import candidate_ids, project, restrict_to_values
from rollbook.queries.registry import query, table

# The priorities of ``orders`` as an ordered dictionary.
PRIORITIES = [
    ("priority_urgent", "1-URGENT", 10, ["urgent"]),
    ("priority_high", "2-HIGH", 20, ["high"]),
    ("priority_medium", "3-MEDIUM", 30, ["medium"]),
    ("priority_unset", "4-NOT SPECIFIED", 40, ["not specified"]),
    ("priority_low", "5-LOW", 50, ["low"]),
]

# The same dictionary for the checks.
PRIORITY_SQL = """(VALUES ('1-URGENT', 'priority_urgent', 10), ('2-HIGH', 'priority_high', 20), ('3-MEDIUM', 'priority_medium', 30),
  ('4-NOT SPECIFIED', 'priority_unset', 40), ('5-LOW', 'priority_low', 50)) AS p(label, id, ordinal)"""


def orders_by_priority(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the priority normalised."""
    mappings = dictionary_mappings(spark, "o_orderpriority", PRIORITIES)
    return apply_mappings(table(spark, folder, "orders"), ["o_orderpriority"], mappings, "o_orderkey")


def _orders(role: str, column: str, operator: str, value):
    def build(spark: SparkSession, folder: str) -> DataFrame:
        return candidate_ids(table(spark, folder, "orders"), "o_orderkey", condition(column, operator, value, role))
    return build


_ORDER_FILTERS = [
    ("filter_eq", "status", "o_orderstatus", "eq", "F", "o_orderstatus = 'F'"),
    ("filter_neq", "status", "o_orderstatus", "neq", "F", "o_orderstatus <> 'F'"),
    ("filter_in", "ordered_category", "o_orderpriority", "in", ["1-URGENT", "2-HIGH"], "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("filter_not_in", "ordered_category", "o_orderpriority", "not_in", ["1-URGENT", "2-HIGH"], "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    ("filter_lt", "numeric", "o_totalprice", "lt", 50000.0, "o_totalprice < 50000.0"),
    ("filter_lte", "date", "o_orderdate", "lte", date(1997, 6, 30), "o_orderdate <= DATE '1997-06-30'"),
    ("filter_gt", "numeric", "o_totalprice", "gt", 400000.0, "o_totalprice > 400000.0"),
    ("filter_between", "date", "o_orderdate", "between", [date(1997, 1, 1), date(1997, 12, 31)],
     "o_orderdate BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"),
]
for _name, _role, _column, _operator, _value, _where in _ORDER_FILTERS:
    query(_name, f"SELECT o_orderkey FROM orders WHERE {_where}")(_orders(_role, _column, _operator, _value))


@query("filter_gte", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45.0
""")
def filter_gte(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").filter(condition("l_quantity", "gte", 45.0, "numeric"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return table(spark, folder, "documents").select("doc_id").join(labels, "doc_id", "left")


@query("filter_is_null", """
SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NULL OR CAST(l.quality AS VARCHAR) = ''
""")
def filter_is_null(spark: SparkSession, folder: str) -> DataFrame:
    return candidate_ids(_labelled(spark, folder), "doc_id", condition("quality", "is_null"))


@query("filter_is_not_null", """
SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NOT NULL AND CAST(l.quality AS VARCHAR) <> ''
""")
def filter_is_not_null(spark: SparkSession, folder: str) -> DataFrame:
    return candidate_ids(_labelled(spark, folder), "doc_id", condition("quality", "is_not_null"))


@query("filter_contains", "SELECT doc_id FROM documents WHERE contains(text, '%')")
def filter_contains(spark: SparkSession, folder: str) -> DataFrame:
    """A literal percent sign, not a wildcard."""
    return candidate_ids(table(spark, folder, "documents"), "doc_id", condition("text", "contains", "%", "long_text"))


@query("filter_starts_with", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red')")
def filter_starts_with(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").filter(condition("p_name", "starts_with", "red", "short_text"))
    return parts.select("p_partkey", "p_name")


@query("filter_ends_with", "SELECT p_partkey, p_name FROM part WHERE suffix(p_name, 'ring')")
def filter_ends_with(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").filter(condition("p_name", "ends_with", "ring", "short_text"))
    return parts.select("p_partkey", "p_name")


@query("filter_ordinal", f"""
SELECT o_orderkey, id AS o_orderpriority, ordinal AS o_orderpriority_ordinal
FROM orders JOIN {PRIORITY_SQL} ON o_orderpriority = label WHERE ordinal >= 30
""")
def filter_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    """Bound written as an alias: medium or less urgent."""
    hits = orders_by_priority(spark, folder).filter(ordinal_condition("o_orderpriority", "gte", "medium", PRIORITIES))
    return hits.select("o_orderkey", "o_orderpriority", "o_orderpriority_ordinal")


@query("filter_ordinal_between", f"""
SELECT o_orderkey FROM orders JOIN {PRIORITY_SQL} ON o_orderpriority = label WHERE ordinal BETWEEN 20 AND 40
""")
def filter_ordinal_between(spark: SparkSession, folder: str) -> DataFrame:
    """A list bound mixing a canonical id and a number."""
    keep = ordinal_condition("o_orderpriority", "between", ["priority_high", 40], PRIORITIES)
    return candidate_ids(orders_by_priority(spark, folder), "o_orderkey", keep)


@query("filter_category_label", f"""
SELECT o_orderkey FROM orders JOIN {PRIORITY_SQL} ON o_orderpriority = label WHERE id = 'priority_low'
""")
def filter_category_label(spark: SparkSession, folder: str) -> DataFrame:
    """A label as literal, resolved to the canonical id before comparing."""
    wanted = canonical_literal("5-LOW", PRIORITIES)
    return candidate_ids(
        orders_by_priority(spark, folder), "o_orderkey", condition("o_orderpriority", "eq", wanted, "ordered_category")
    )


@query("filter_conjunction", f"""
SELECT o_orderkey FROM orders JOIN {PRIORITY_SQL} ON o_orderpriority = label
WHERE ordinal <= 20 AND o_orderstatus <> 'P' AND o_totalprice BETWEEN 100000.0 AND 300000.0 AND o_orderdate >= DATE '1998-01-01'
""")
def filter_conjunction(spark: SparkSession, folder: str) -> DataFrame:
    keep = all_of([
        ordinal_condition("o_orderpriority", "lte", "priority_high", PRIORITIES),
        condition("o_orderstatus", "neq", "P", "status"),
        condition("o_totalprice", "between", [100000.0, 300000.0], "numeric"),
        condition("o_orderdate", "gte", date(1998, 1, 1), "date"),
    ])
    return candidate_ids(orders_by_priority(spark, folder), "o_orderkey", keep)


@query("project_records", "SELECT doc_id, source, lang FROM documents")
def project_records(spark: SparkSession, folder: str) -> DataFrame:
    return project(table(spark, folder, "documents"), ["source", "doc_id", "lang", "source"], "doc_id")


@query("filter_in_table", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def filter_in_table(spark: SparkSession, folder: str) -> DataFrame:
    """A value list that is a table."""
    listed = table(spark, folder, "part").filter("p_size > 25").select("p_partkey")
    return restrict_to_values(table(spark, folder, "lineitem"), "l_partkey", listed).select("l_orderkey", "l_linenumber")


@query("filter_not_in_table", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def filter_not_in_table(spark: SparkSession, folder: str) -> DataFrame:
    listed = table(spark, folder, "part").filter("p_size > 25").select("p_partkey")
    return restrict_to_values(table(spark, folder, "lineitem"), "l_partkey", listed, keep=False).select("l_orderkey", "l_linenumber")
