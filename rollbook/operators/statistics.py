"""Exact counts over a candidate set: distributions, cross-tabs, trends.

However many dimensions are asked for, the rows are read once: each row is
unpivoted to (dimension, value) pairs that collapse in the map-side aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollbook.fixed import (
    DEFAULT_CROSS_PAIRS,
    LANDSCAPE_PHASE_COLUMNS,
    LANDSCAPE_TYPE_COLUMN,
    NULL_CATEGORY,
    TOP_CATEGORIES,
    TOP_CROSS_CELLS,
)
from rollbook.functions.text import percentage
from rollbook.operators.reshape import cells
from rollbook.session import literal_frame


def category_of(df: DataFrame, column: str) -> Column:
    """The label where there is one, else the value, else the NULL marker."""
    options = [F.col(c).cast("string") for c in (f"{column}_label", column) if c in df.columns]
    return F.coalesce(*options, F.lit(NULL_CATEGORY))


def category_counts(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """``(dimension, category, count)`` for all dimensions from one scan."""
    pairs = cells(df, {d: category_of(df, d) for d in dimensions}, "dimension", "category")
    return pairs.groupBy("dimension", "category").agg(F.count(F.lit(1)).alias("count"))


def distributions(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Counts with their share of all rows, per dimension."""
    counts = category_counts(df, dimensions)
    # one row per dimension named in the call
    totals = counts.groupBy("dimension").agg(F.sum("count").alias("total"))
    return counts.join(F.broadcast(totals), "dimension").select(
        "dimension", "category", "count", percentage(F.col("count"), F.col("total")).alias("percentage")
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    return distributions(df, [column]).drop("dimension")


def landscape(df: DataFrame) -> DataFrame:
    """Phase and type concentration of a whole register."""
    phase = [c for c in LANDSCAPE_PHASE_COLUMNS if c in df.columns][:1]
    kind = [c for c in [LANDSCAPE_TYPE_COLUMN] if c in df.columns]
    return distributions(df, phase + kind)


def default_pairs(df: DataFrame) -> list[tuple[str, str]]:
    """The usual pairs, as far as both columns exist."""
    return [(a, b) for a, b in DEFAULT_CROSS_PAIRS if a in df.columns and b in df.columns]


def cross_tabs(df: DataFrame, pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """``(pair, row_value, column_value, count)`` for all pairs from one scan."""
    pairs = default_pairs(df) if pairs is None else list(pairs)
    if not pairs:
        return literal_frame(
            df.sparkSession, [], [("pair", "string"), ("row_value", "string"), ("column_value", "string"), ("count", "long")]
        )
    pair_cells = F.array(*[
        F.struct(
            F.lit(f"{a}_x_{b}").alias("pair"),
            category_of(df, a).alias("row_value"),
            category_of(df, b).alias("column_value"),
        )
        for a, b in pairs
    ])
    return (
        df.select(F.inline(pair_cells))
        .groupBy("pair", "row_value", "column_value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def cross_tab(df: DataFrame, a: str, b: str) -> DataFrame:
    return cross_tabs(df, [(a, b)]).drop("pair")


def monthly_trend(df: DataFrame, date_columns: Sequence[str]) -> DataFrame:
    """Rows per month and date column; rows without a date are left out."""
    months = {c: F.substring(F.col(c).cast("string"), 1, 7) for c in date_columns}
    return (
        cells(df, months, "dimension", "year_month")
        .filter(F.col("year_month") != "")
        .groupBy("dimension", "year_month")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def top_categories(counts: DataFrame, n: int = TOP_CATEGORIES) -> DataFrame:
    """The ``n`` largest categories of each dimension, and one row for the rest.

    The remainder row has rank ``n + 1``, the number of categories left out
    and their rows.  Ties go by category.
    """
    by_size = W.partitionBy("dimension").orderBy(F.desc("count"), "category")
    top = counts.withColumn("rank", F.row_number().over(by_size)).filter(F.col("rank") <= n)
    top = top.select("dimension", "rank", "category", "count", F.lit(0).cast("long").alias("more_categories"))
    shown = top.groupBy("dimension").agg(F.count(F.lit(1)).alias("shown"), F.sum("count").alias("shown_rows"))
    whole = counts.groupBy("dimension").agg(F.count(F.lit(1)).alias("all"), F.sum("count").alias("all_rows"))
    rest = (
        whole.join(shown, "dimension")
        .filter(F.col("all") > F.col("shown"))
        .select(
            "dimension",
            F.lit(n + 1).alias("rank"),
            F.lit("...").alias("category"),
            (F.col("all_rows") - F.col("shown_rows")).alias("count"),
            (F.col("all") - F.col("shown")).alias("more_categories"),
        )
    )
    return top.unionByName(rest)


def top_cross_cells(table: DataFrame, n: int = TOP_CROSS_CELLS) -> DataFrame:
    """The ``n`` largest cells of each cross-tab; ties go by row, then column."""
    by_size = W.partitionBy("pair").orderBy(F.desc("count"), "row_value", "column_value")
    return table.withColumn("rank", F.row_number().over(by_size)).filter(F.col("rank") <= n)
