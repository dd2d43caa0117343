"""Distributions, cross-tabs, trends and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators import statistics as st
from rollbook.queries.filters import orders_by_priority
from rollbook.queries.registry import query, table


def _counts_sql(table_name: str, columns: dict[str, str]) -> str:
    """Counts per dimension; ``columns`` maps the dimension to its SQL expression."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS dimension, coalesce(CAST({expr} AS VARCHAR), '(NULL)') AS category, count(*) AS count FROM {table_name} GROUP BY 2"
        for name, expr in columns.items()
    )


def _shares_sql(counts: str) -> str:
    return f"""SELECT dimension, category, count, round(count * 100.0 / sum(count) OVER (PARTITION BY dimension), 2) AS percentage
FROM ({counts})"""


_ORDER_DIMENSIONS = {
    "o_orderpriority": "o_orderpriority", "o_orderstatus": "o_orderstatus", "o_orderdate": "o_orderdate",
}
_PART_DIMENSIONS = {"p_type": "p_type", "p_brand": "p_brand", "p_name": "p_name", "p_size": "p_size"}


@query("distribution", f"SELECT category, count, percentage FROM ({_shares_sql(_counts_sql('orders', {'s': 'o_orderpriority'}))})")
def distribution(spark: SparkSession, folder: str) -> DataFrame:
    """By label, as the column is normalised."""
    return st.distribution(orders_by_priority(spark, folder), "o_orderpriority")


@query("distribution_with_null", f"""
SELECT category, count, percentage FROM ({_shares_sql(_counts_sql(
    '(SELECT l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)', {'s': 'toxic'}))})
""")
def distribution_with_null(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    return st.distribution(table(spark, folder, "documents").select("doc_id").join(labels, "doc_id", "left"), "toxic")


@query("statistics_long", _shares_sql(_counts_sql("orders", _ORDER_DIMENSIONS)))
def statistics_long(spark: SparkSession, folder: str) -> DataFrame:
    """All dimensions at once, the date among them."""
    return st.distributions(orders_by_priority(spark, folder), list(_ORDER_DIMENSIONS))


@query("statistics_long_part", _shares_sql(_counts_sql("part", _PART_DIMENSIONS)))
def statistics_long_part(spark: SparkSession, folder: str) -> DataFrame:
    return st.distributions(table(spark, folder, "part"), list(_PART_DIMENSIONS))


@query("cross_tab", """
SELECT o_orderpriority AS row_value, o_orderstatus AS column_value, count(*) AS count FROM orders GROUP BY 1, 2
""")
def cross_tab(spark: SparkSession, folder: str) -> DataFrame:
    return st.cross_tab(table(spark, folder, "orders"), "o_orderpriority", "o_orderstatus")


def _cells_sql(table_name: str, pairs: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}_x_{b}' AS pair, CAST({a} AS VARCHAR) AS row_value, CAST({b} AS VARCHAR) AS column_value, count(*) AS count "
        f"FROM {table_name} GROUP BY 2, 3" for a, b in pairs
    )


_PART_PAIRS = [("p_type", "p_brand"), ("p_name", "p_type"), ("p_brand", "p_size")]


@query("cross_tabs_all", _cells_sql("part", _PART_PAIRS))
def cross_tabs_all(spark: SparkSession, folder: str) -> DataFrame:
    return st.cross_tabs(table(spark, folder, "part"), _PART_PAIRS)


def _as_register(spark: SparkSession, folder: str) -> DataFrame:
    """Orders under the usual register column names."""
    return orders_by_priority(spark, folder).select(
        F.col("o_orderpriority").alias("detect_phase"),
        F.col("o_orderpriority_label").alias("detect_phase_label"),
        F.col("o_orderstatus").alias("defect_type"),
        F.col("o_orderstatus").alias("severity"),
    )


@query("cross_tabs_default", """
SELECT 'detect_phase_x_defect_type' AS pair, o_orderpriority AS row_value, o_orderstatus AS column_value, count(*) AS count FROM orders GROUP BY 2, 3
UNION ALL
SELECT 'severity_x_detect_phase', o_orderstatus, o_orderpriority, count(*) FROM orders GROUP BY 2, 3
""")
def cross_tabs_default(spark: SparkSession, folder: str) -> DataFrame:
    """The usual pairs, of those whose columns exist."""
    return st.cross_tabs(_as_register(spark, folder))


@query("landscape", _shares_sql(_counts_sql("orders", {"detect_phase": "o_orderpriority", "defect_type": "o_orderstatus"})))
def landscape(spark: SparkSession, folder: str) -> DataFrame:
    return st.landscape(_as_register(spark, folder))


@query("monthly_trend", """
SELECT 'o_orderdate' AS dimension, substring(CAST(o_orderdate AS VARCHAR), 1, 7) AS year_month, count(*) AS count
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 2
""")
def monthly_trend(spark: SparkSession, folder: str) -> DataFrame:
    return st.monthly_trend(table(spark, folder, "orders"), ["o_orderdate"])


@query("monthly_trend_lines", """
SELECT 'l_shipdate' AS dimension, substring(CAST(l_shipdate AS VARCHAR), 1, 7) AS year_month, count(*) AS count
FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 2
""")
def monthly_trend_lines(spark: SparkSession, folder: str) -> DataFrame:
    return st.monthly_trend(table(spark, folder, "lineitem"), ["l_shipdate"])


@query("top_categories", f"""
WITH counts AS ({_counts_sql('part', _PART_DIMENSIONS)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY count DESC, category) AS rank FROM counts)
SELECT dimension, CAST(rank AS INTEGER) AS rank, category, count, 0 AS more_categories FROM ranked WHERE rank <= 8
UNION ALL
SELECT dimension, 9, '...', CAST(sum(count) AS BIGINT), count(*) FROM ranked WHERE rank > 8 GROUP BY dimension
""")
def top_categories(spark: SparkSession, folder: str) -> DataFrame:
    return st.top_categories(st.category_counts(table(spark, folder, "part"), list(_PART_DIMENSIONS)))


@query("top_cross_cells", f"""
SELECT pair, row_value, column_value, count, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY pair ORDER BY count DESC, row_value, column_value) AS rank
  FROM ({_cells_sql('orders', [('o_orderpriority', 'o_orderstatus'), ('o_orderstatus', 'o_orderpriority')])}))
WHERE rank <= 10
""")
def top_cross_cells(spark: SparkSession, folder: str) -> DataFrame:
    pairs = [("o_orderpriority", "o_orderstatus"), ("o_orderstatus", "o_orderpriority")]
    return st.top_cross_cells(st.cross_tabs(table(spark, folder, "orders"), pairs))
