"""Candidate ids: set algebra, trace, and fetching the rows behind them.

A candidate set is a DataFrame with one distinct id column and stays one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.fixed import JUDGMENTS
from rollbook.operators.numbering import number_rows
from rollbook.session import materialise

# More ids than this do not meet in one task.
REPORT_IDS = 10_000
# Parts of a round's histogram, each a row on the driver.
CUT_RANGES = 1024


def candidate_ids(df: DataFrame, id_column: str, keep: Column) -> DataFrame:
    """Ids of the rows that satisfy the predicate."""
    return df.filter(keep).select(id_column)


def intersect_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def except_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def combine_ids(filtered: DataFrame | None, searched: DataFrame | None, operation: str = "INTERSECT") -> DataFrame:
    """Combine the two retrieval sides; a missing side passes the other through."""
    if filtered is None and searched is None:
        raise ValueError("neither a filter nor a search side")
    if searched is None or operation == "SQL_ONLY":
        return filtered
    if filtered is None or operation == "FTS_ONLY":
        return searched
    by_name = {"INTERSECT": intersect_ids, "UNION": union_ids, "EXCEPT": except_ids}
    return by_name[operation](filtered, searched)


def limit_ids(ids: DataFrame, id_column: str, n: int) -> DataFrame:
    """The first ``n`` ids in id order; apply after set algebra.

    A report limit, up to ``REPORT_IDS``, meets in one task.  A larger one is a filter: up to a cut for whole
    numbers and dates, by row numbers over range partitions for other ids.
    """
    if n <= REPORT_IDS:
        return ids.orderBy(id_column).limit(n)
    ids = materialise(ids.select(id_column), "ids")
    if ids.schema[id_column].dataType.typeName() in ("byte", "short", "integer", "long", "date"):
        return _up_to_cut(ids, id_column, n)
    first = F.asc_nulls_first(id_column)
    return number_rows(ids, [first], "_number").filter(F.col("_number") <= n).select(id_column)


def _up_to_cut(ids: DataFrame, id_column: str, n: int) -> DataFrame:
    """The ``n`` smallest of distinct whole numbers: histograms of ever narrower ranges find the last one taken.

    Each round counts the ids of one range in ``CUT_RANGES`` parts, and goes on in the part that the limit falls
    into, so that seven rounds find the cut among all 64-bit numbers.  NULL comes first, as in an ordered limit.
    """
    value = F.col(id_column)
    if ids.schema[id_column].dataType.typeName() == "date":
        value = F.unix_date(value)
    value = value.cast("decimal(20,0)")
    nulls, low, high = ids.agg(F.count_if(value.isNull()), F.min(value), F.max(value)).first()
    if low is None:
        return ids
    low, high, left = int(low), int(high), n - nulls
    values = ids.select(value.alias("_value"))
    while low < high:
        width = -(-(high - low + 1) // CUT_RANGES)
        part = F.expr(f"int((_value - ({low}BD)) div {width}BD)").alias("part")
        # one row per part, whatever the number of ids
        counts = dict(values.filter(f"_value BETWEEN ({low}BD) AND ({high}BD)").groupBy(part).count().collect())
        for at in range(CUT_RANGES):
            if left <= counts.get(at, 0):
                low, high = low + at * width, min(high, low + (at + 1) * width - 1)
                break
            left -= counts.get(at, 0)
        else:
            break  # fewer ids than the limit
    return ids.filter(value.isNull() | (value <= F.lit(high).cast("decimal(20,0)")))


def retrieval_trace(filtered: DataFrame, searched: DataFrame, id_column: str, operation: str = "INTERSECT") -> DataFrame:
    """Size of each side and of the result, counted in one pass over both sides."""
    tagged = filtered.select(id_column, F.lit(1).alias("f"), F.lit(0).alias("s")).unionByName(
        searched.select(id_column, F.lit(0).alias("f"), F.lit(1).alias("s"))
    )
    per_id = tagged.groupBy(id_column).agg(F.max("f").alias("f"), F.max("s").alias("s"))
    return _trace(per_id, F.col("f") == 1, F.col("s") == 1, operation)


def retrieval_trace_one_table(df: DataFrame, keep: Column, hit: Column, operation: str = "INTERSECT") -> DataFrame:
    """The same counts when both sides read one table with unique ids: one scan, no shuffle of ids."""
    flags = df.select(F.coalesce(keep, F.lit(False)).alias("f"), F.coalesce(hit, F.lit(False)).alias("s"))
    return _trace(flags, F.col("f"), F.col("s"), operation)


def _trace(flags: DataFrame, f: Column, s: Column, operation: str) -> DataFrame:
    final = {"INTERSECT": f & s, "UNION": f | s, "EXCEPT": f & ~s, "SQL_ONLY": f, "FTS_ONLY": s}[operation]
    return flags.agg(
        F.count_if(f).alias("sql_matched_count"),
        F.count_if(s).alias("fts_matched_count"),
        F.lit(operation).alias("set_operation"),
        F.count_if(final).alias("final_candidate_count"),
    )


def restrict_to_values(df: DataFrame, column: str, values: DataFrame, keep: bool = True) -> DataFrame:
    """Rows whose value is, or with ``keep`` off is not, in a one-column table: for lists too long for a predicate.

    As in the predicates, a NULL value is in no list and passes neither way.
    """
    listed = values.select(F.col(values.columns[0]).alias("_value")).filter("_value IS NOT NULL").distinct()
    rows = df.filter(F.col(column).isNotNull())
    return rows.join(listed, rows[column] == listed["_value"], "left_semi" if keep else "left_anti")


def restrict(df: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows whose id is a candidate; no column of the id frame leaks in.

    Repeated ids collapse before the shuffle, so a hot id is one row there.
    """
    return df.join(ids.select(id_column).distinct(), id_column, "left_semi")


def project(df: DataFrame, columns: Sequence[str], id_column: str) -> DataFrame:
    """Id first, each column once."""
    return df.select(id_column, *[c for c in dict.fromkeys(columns) if c != id_column])


def fetch_records(
    df: DataFrame, ids: DataFrame, id_column: str, columns: Sequence[str] | None = None, order: str | None = None,
) -> DataFrame:
    """Projected candidate rows.  Give ``order`` only where the output must be in source order."""
    kept = restrict(df, ids, id_column)
    wanted = df.columns if columns is None else columns
    if order is None:
        return project(kept, wanted, id_column)
    return project(kept.orderBy(order), wanted, id_column)


def semantic_filter(ids: DataFrame, judgments: DataFrame, id_column: str, keep_uncertain: bool = False) -> DataFrame:
    """Apply outside judgments; an id nobody judged is UNCERTAIN.

    ``judgments`` has one row per id: id, judgment, reason.  A judgment in
    other words is UNCERTAIN too.
    """
    known = F.when(F.col("judgment").isin(JUDGMENTS), F.col("judgment")).otherwise(F.lit("UNCERTAIN"))
    judged = ids.join(judgments.select(id_column, "judgment", "reason"), id_column, "left").withColumn("judgment", known)
    keep = ["MATCH", "UNCERTAIN"] if keep_uncertain else ["MATCH"]
    return judged.filter(F.col("judgment").isin(keep))
