"""Candidate sets as bitmaps over dense row numbers.

A set is a table ``(bucket, bits)``: one bitmap of 32,768 places per bucket of row numbers that has a member.
Set algebra then shuffles one row per bucket and side, however many ids a side holds; mostly empty bitmaps shrink in
Spark's shuffle and file compression.  Numbers count from 1 (``numbering.number_rows``) and are given once per register.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from rollbook.functions.text import percentage
from rollbook.operators.joins import BROADCAST_BYTES_MAX
from rollbook.operators.reduction import bit_is_set

BITMAP_BYTES = 1 << 12


@F.pandas_udf(BinaryType())
def _and_not(a: pd.Series, b: pd.Series) -> pd.Series:
    """Places of ``a`` that ``b`` lacks, for one bitmap of each per bucket."""
    return pd.Series([
        (np.frombuffer(x, dtype=np.uint8) & ~np.frombuffer(y, dtype=np.uint8)).tobytes() for x, y in zip(a, b)], dtype=object)


def id_set(numbers: DataFrame, number: str) -> DataFrame:
    """The set of the row numbers in a column; repeated and NULL numbers add nothing.

    Tasks build their bitmaps before anything is shuffled.
    """
    n = F.col(number).cast("long")
    return numbers.filter(n.isNotNull()).groupBy(F.bitmap_bucket_number(n).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits"))


def _side_by_side(sides: dict[str, DataFrame]) -> DataFrame:
    """One row per bucket with a bitmap for each side, empty where the side has no member there."""
    tagged = None
    for name, ids in sides.items():
        rows = ids.select("bucket", F.lit(name).alias("side"), "bits")
        tagged = rows if tagged is None else tagged.unionByName(rows)
    return tagged.groupBy("bucket").agg(*[
        F.bitmap_or_agg(F.when(F.col("side") == name, F.col("bits"))).alias(name) for name in sides])


def union_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def intersect_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """A bucket that one side lacks has no common member."""
    met = a.unionByName(b).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    return met.filter((F.col("n") == 2) & (F.bitmap_count("bits") > 0)).select("bucket", "bits")


def except_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    left = _side_by_side({"f": a, "s": b}).select("bucket", _and_not("f", "s").alias("bits"))
    return left.filter(F.bitmap_count("bits") > 0)


def combine_sets(filtered: DataFrame | None, searched: DataFrame | None, operation: str = "INTERSECT") -> DataFrame:
    """As ``selection.combine_ids``: a missing side passes the other through."""
    if filtered is None and searched is None:
        raise ValueError("neither a filter nor a search side")
    if searched is None or operation == "SQL_ONLY":
        return filtered
    if filtered is None or operation == "FTS_ONLY":
        return searched
    return {"INTERSECT": intersect_sets, "UNION": union_sets, "EXCEPT": except_sets}[operation](filtered, searched)


def set_size(ids: DataFrame) -> DataFrame:
    return ids.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n_ids"))


def members(rows: DataFrame, number: str, ids: DataFrame, keep: bool = True) -> DataFrame:
    """Rows whose number is, or with ``keep`` off is not, in the set.

    The set goes to all tasks while its counted buckets fit the bound, and meets the rows by bucket beyond it.
    NULL numbers are in no set and pass neither way.
    """
    n = F.col(number).cast("long")
    marked = rows.filter(n.isNotNull()).withColumns({"_bucket": F.bitmap_bucket_number(n), "_bit": F.bitmap_bit_position(n)})
    side = ids.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    if ids.count() * BITMAP_BYTES <= BROADCAST_BYTES_MAX:
        side = F.broadcast(side)
    held = F.coalesce(bit_is_set("_bits", F.col("_bit")), F.lit(False))
    return marked.join(side, "_bucket", "inner" if keep else "left").filter(held if keep else ~held).select(*rows.columns)


def set_trace(filtered: DataFrame, searched: DataFrame, operation: str = "INTERSECT") -> DataFrame:
    """Size of each side and of the result, as ``selection.retrieval_trace`` counts them, from one row per bucket."""
    sides = _side_by_side({"f": filtered, "s": searched})
    f, s, left = (F.coalesce(F.sum(F.bitmap_count(c)), F.lit(0)) for c in ("f", "s", "left"))
    final = {"INTERSECT": f - left, "UNION": s + left, "EXCEPT": left, "SQL_ONLY": f, "FTS_ONLY": s}[operation]
    return sides.withColumn("left", _and_not("f", "s")).agg(
        f.alias("sql_matched_count"), s.alias("fts_matched_count"), F.lit(operation).alias("set_operation"), final.alias("final_candidate_count"))


def set_coverage(candidates: DataFrame, evaluated: DataFrame, failed: DataFrame) -> DataFrame:
    """``packing.coverage`` of three sets, counted from one row per bucket."""
    sides = _side_by_side({"c": candidates, "e": evaluated, "f": failed, "reviewed": evaluated.unionByName(failed)})
    sides = sides.withColumn("skipped", _and_not("c", "reviewed")).withColumn("outside", _and_not("reviewed", "c"))
    names = {"c": "total_candidates", "e": "evaluated_count", "f": "failed_count", "skipped": "skipped_count", "outside": "outside_candidates"}
    counts = sides.agg(*[F.coalesce(F.sum(F.bitmap_count(c)), F.lit(0)).alias(name) for c, name in names.items()])
    total, done = F.col("total_candidates"), F.col("evaluated_count")
    return counts.withColumn("coverage_percentage", F.when(total > 0, percentage(done, total)).otherwise(F.lit(100.0))).withColumn(
        "is_100_percent_covered", (total == done) & (F.col("skipped_count") == 0) & (F.col("failed_count") == 0))
