"""Data-quality audit of a register, from one pass over it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.fixed import SUPERFICIAL_WORDS
from rollbook.functions.text import KEY_BYTES, any_contains, distinct_key, is_blank, percentage, round_half_up
from rollbook.operators.reshape import cells

# Bits of a sketch's registers: counts come within about half a percent.
SKETCH_PRECISION = 15


def value_groups(df: DataFrame, columns: Sequence[str], tests: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """One row per column and distinct value: key, rows, blank rows, length.

    All the per-column measures follow from these groups, so many columns and
    an exact distinct count still cost one scan and one shuffle of short keys.
    ``tests`` adds named yes/no tests of the value.  A short value is its own
    key and is tested once per group; only long values are tested row by row.
    """
    tests = tests or {}
    long = F.octet_length("value") >= KEY_BYTES
    measured = cells(df, {c: F.col(c) for c in columns}, "column_id", "value").select(
        "column_id",
        distinct_key(F.col("value")).alias("key"),
        F.length("value").alias("len"),
        is_blank(F.col("value")).alias("blank"),
        *[F.when(long, test(F.col("value"))).alias(name) for name, test in tests.items()],
    )
    groups = measured.groupBy("column_id", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("len").cast("long").alias("len"),
        F.max("blank").alias("blank"),
        *[F.max(name).alias(name) for name in tests],
    )
    short = F.octet_length("key") < KEY_BYTES
    return groups.withColumns({
        name: F.when(short, test(F.col("key").cast("string"))).otherwise(F.coalesce(name, F.lit(False))) for name, test in tests.items()
    }) if tests else groups


def audit_columns(df: DataFrame, columns: Sequence[str], text_columns: Sequence[str] = ()) -> DataFrame:
    """Blank count and share, exact distinct count, and lengths of text columns."""
    return _measures(value_groups(df, columns), text_columns)


def _measures(groups: DataFrame, text_columns: Sequence[str]) -> DataFrame:
    filled = ~F.col("blank") & F.col("column_id").isin(list(text_columns))
    per_column = groups.groupBy("column_id").agg(
        F.sum("n").alias("total_records"),
        F.coalesce(F.sum(F.when(F.col("blank"), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("key").alias("distinct_count"),
        F.coalesce(F.min(F.when(filled, F.col("len"))), F.lit(0)).alias("min_len"),
        F.coalesce(F.max(F.when(filled, F.col("len"))), F.lit(0)).alias("max_len"),
        F.sum(F.when(filled, F.col("len") * F.col("n"))).alias("chars"),
        F.sum(F.when(filled, F.col("n"))).alias("filled"),
    )
    return per_column.select(
        "column_id",
        "total_records",
        "null_count",
        percentage(F.col("null_count"), F.col("total_records")).alias("null_percentage"),
        "distinct_count",
        "min_len",
        "max_len",
        F.coalesce(round_half_up(F.col("chars") / F.col("filled"), 1), F.lit(0.0)).alias("avg_len"),
    )


def distinct_sketches(df: DataFrame, columns: Sequence[str], part: str | Column | None = None, precision: int = SKETCH_PRECISION) -> DataFrame:
    """``(column_id, part, sketch)``: the distinct values of each column, by part (a source file, say), in a few kilobytes.

    Sketches of parts can be kept and merged later; a value is sketched as text, NULL is none.
    """
    key = F.lit(None).cast("string") if part is None else (F.col(part) if isinstance(part, str) else part)
    values = F.array(*[F.struct(F.lit(c).alias("column_id"), F.col(c).cast("string").alias("value")) for c in columns])
    cell = df.select(key.cast("string").alias("part"), F.inline(values))
    # in two sketches each, as merged sketches estimate by another rule than those made in one pass
    halves = cell.withColumn("half", F.pmod(F.xxhash64("value"), F.lit(2)))
    return halves.groupBy("column_id", "part", "half").agg(F.hll_sketch_agg("value", F.lit(precision)).alias("sketch")).drop("half")


def approximate_distinct(sketches: DataFrame) -> DataFrame:
    """``(column_id, distinct_count)`` over all parts, whichever way the rows were dealt to them."""
    merged = sketches.groupBy("column_id").agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("column_id", F.hll_sketch_estimate("sketch").alias("distinct_count"))


def identical_fields(a: str, b: str) -> Column:
    """True where two text columns hold the same non-empty text."""
    return F.coalesce((F.col(a) == F.col(b)) & (F.col(a) != ""), F.lit(False))


def superficial(column: str, words: Sequence[str] = tuple(SUPERFICIAL_WORDS)) -> Column:
    """True where a text holds any of the tell-tale words."""
    return any_contains(F.col(column), list(words))


def count_rows(df: DataFrame, **tests: Column) -> DataFrame:
    """Total rows and, for each named test, the rows passing it."""
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        *[F.count_if(test).alias(name) for name, test in tests.items()],
    )


def audit_summary(
    df: DataFrame, columns: Sequence[str], text_columns: Sequence[str], tests: Mapping[str, Column],
) -> DataFrame:
    """The whole audit as ``(subject, metric, value)`` rows, from one scan.

    Row-level tests ride along as extra columns holding a mark where they pass.
    """
    marks = {f"test:{name}": F.when(test, F.lit("1")) for name, test in tests.items()}
    widened = df.select(*[F.col(c).cast("string").alias(c) for c in columns], *[m.alias(n) for n, m in marks.items()])
    measured = _measures(value_groups(widened, [*columns, *marks]), text_columns)
    is_test = F.col("column_id").startswith("test:")
    names = ["total_records", "null_count", "null_percentage", "distinct_count", "min_len", "max_len", "avg_len"]
    per_column = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    per_test = F.array(
        F.struct(F.lit("count").alias("metric"), (F.col("total_records") - F.col("null_count")).cast("double").alias("value"))
    )
    return measured.select(
        F.regexp_replace("column_id", "^test:", "").alias("subject"),
        F.inline(F.when(is_test, per_test).otherwise(per_column)),
    )
