"""Checks of a finished build."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.fixed import MESSAGE_INDEX_OK, MESSAGE_STRUCTURE
from rollbook.operators.reshape import cells


def validate_build(
    raw: DataFrame, normalised: DataFrame, indexed_ids: DataFrame, id_column: str, n_columns: int,
    category_columns: Sequence[str] = (),
) -> DataFrame:
    """Findings ``(severity, category, message)`` about row counts, ids and unmapped values.

    The three id sets are compared in one shuffle; a repeated id collapses
    before it, so one id holding many rows is no hot spot.
    """
    tables = {"raw": raw.select(id_column), "normalised": normalised.select(id_column), "indexed": indexed_ids.select(id_column)}
    tagged = reduce(DataFrame.unionByName, [
        ids.select(F.col(id_column).cast("string").alias("id"), *[F.lit(int(name == t)).alias(t) for t in tables])
        for name, ids in tables.items()
    ])
    per_id = tagged.groupBy("id").agg(*[F.sum(t).alias(t) for t in tables])
    totals = per_id.agg(
        *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in tables],
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("normalised"))), F.lit(0)).alias("null_ids"),
        F.count_if(F.col("id").isNotNull() & (F.col("normalised") > 1)).alias("repeated_ids"),
        F.count_if((F.col("normalised") > 0) & (F.col("indexed") == 0)).alias("unindexed"),
        F.count_if((F.col("indexed") > 0) & (F.col("normalised") == 0)).alias("stray"),
    )
    n = F.col
    findings = [
        _finding((n("normalised") == n("indexed")) & (n("unindexed") == 0) & (n("stray") == 0),
                 "INFO", "fts", F.format_string(MESSAGE_INDEX_OK, n("indexed"))),
        _finding((n("normalised") != n("indexed")) | (n("unindexed") > 0) | (n("stray") > 0),
                 "ERROR", "fts", F.format_string("Index holds %d records, register holds %d.", n("indexed"), n("normalised"))),
        _finding(F.lit(True), "INFO", "structure",
                 F.format_string(MESSAGE_STRUCTURE, n("normalised"), F.lit(n_columns))),
        _finding(n("raw") != n("normalised"), "ERROR", "structure",
                 F.format_string("Raw table holds %d records, normalised table %d.", n("raw"), n("normalised"))),
        _finding(n("null_ids") > 0, "ERROR", "record_id", F.format_string("%d records have no id.", n("null_ids"))),
        _finding(n("repeated_ids") > 0, "ERROR", "record_id", F.format_string("%d ids occur more than once.", n("repeated_ids"))),
    ]
    found = totals.select(F.explode(F.array_compact(F.array(*findings))).alias("f")).select("f.*")
    unmapped = cells(normalised, {
        c: F.when(F.col(f"{c}_ordinal").isNull() & F.col(c).isNotNull(), F.lit(1)) for c in category_columns
    }, "column_id", "unmapped")
    warnings = (
        unmapped.groupBy("column_id").agg(F.count("unmapped").alias("n")).filter(F.col("n") > 0).select(
            F.lit("WARNING").alias("severity"), F.lit("normalization").alias("category"),
            F.format_string("%d records hold unmapped values in %s.", F.col("n"), F.col("column_id")).alias("message"),
        )
    )
    return found.unionByName(warnings)


def _finding(holds: Column, severity: str, category: str, message: Column) -> Column:
    return F.when(holds, F.struct(
        F.lit(severity).alias("severity"), F.lit(category).alias("category"), message.alias("message"),
    ))


def is_valid(findings: DataFrame) -> DataFrame:
    """Counts by severity; a build is valid when none is an ERROR."""
    return findings.agg(
        F.count_if(F.col("severity") == "ERROR").alias("error_count"),
        F.count_if(F.col("severity") == "WARNING").alias("warning_count"),
        F.count_if(F.col("severity") == "INFO").alias("info_count"),
        (F.count_if(F.col("severity") == "ERROR") == 0).alias("is_valid"),
    )
