"""Column profiles, role inference and the column catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.fixed import CAPABILITIES, ROLE_CAPABILITIES
from rollbook.functions.text import looks_like_date, looks_like_number
from rollbook.operators.quality import value_groups
from rollbook.session import literal_frame

# Words in a column name that point to a role.  Defaults; pass your own.
NAME_WORDS = {
    "record_id": ["_id", "id_", "key", "番号"],
    "ordered_category": ["phase", "stage", "priority", "工程", "フェーズ"],
    "short_text": ["title", "summary", "subject", "name", "url", "件名", "タイトル"],
    "long_text": ["cause", "text", "html", "description", "countermeasure", "comment", "原因", "対策", "内容"],
    "status": ["status", "state", "状態"],
}


def profile_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null share, distinct count, lengths, and share of dates and numbers per column."""
    groups = value_groups(df, columns, {"is_date": looks_like_date, "is_number": looks_like_number})
    filled = ~F.col("blank")
    n_filled = F.sum(F.when(filled, F.col("n")).otherwise(0))
    per_column = groups.groupBy("column_id").agg(
        F.sum("n").alias("n_records"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("null_count"),
        F.count(F.when(filled, F.col("key"))).alias("distinct_count"),
        F.coalesce(F.min(F.when(filled, F.col("len"))), F.lit(0)).alias("min_len"),
        F.coalesce(F.max(F.when(filled, F.col("len"))), F.lit(0)).alias("max_len"),
        F.sum(F.when(filled, F.col("len") * F.col("n")).otherwise(0)).alias("chars"),
        F.sum(F.when(filled & F.col("is_date"), F.col("n")).otherwise(0)).alias("dates"),
        F.sum(F.when(filled & F.col("is_number"), F.col("n")).otherwise(0)).alias("numbers"),
        n_filled.alias("filled"),
    )

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    return per_column.select(
        "column_id",
        "n_records",
        "null_count",
        share("null_count", "n_records").alias("null_ratio"),
        "distinct_count",
        share("distinct_count", "n_records").alias("distinct_ratio"),
        "min_len",
        "max_len",
        share("chars", "filled").alias("avg_len"),
        share("dates", "filled").alias("date_ratio"),
        share("numbers", "filled").alias("number_ratio"),
    )


def infer_roles(
    profiles: DataFrame,
    id_column: str | None = None,
    name_words: dict[str, list[str]] | None = None,
    unique_ratio: float = 0.95,
    date_ratio: float = 0.8,
    number_ratio: float = 0.8,
    max_categories: int = 50,
    long_text_len: float = 60.0,
) -> DataFrame:
    """Add the proposed role and the rule that chose it; the first rule wins."""
    words = {**NAME_WORDS, **(name_words or {})}
    name = F.lower("column_id")

    def named(role: str) -> Column:
        return name.rlike("|".join(words[role]))

    few = F.col("distinct_count") <= max_categories
    unique = F.col("distinct_ratio") >= unique_ratio
    rules = [
        ("record_id", "id", (F.col("column_id") == F.lit(id_column or "")) | (named("record_id") & unique)),
        ("ordered_category", "phase word", named("ordered_category")),
        ("short_text", "title word", named("short_text")),
        ("long_text", "narrative word", named("long_text")),
        ("status", "status word", named("status") & few),
        ("date", "dates", F.col("date_ratio") >= date_ratio),
        ("numeric", "numbers", F.col("number_ratio") >= number_ratio),
        ("category", "few values", few),
        ("long_text", "long values", F.col("avg_len") >= long_text_len),
    ]
    role, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for chosen, why, test in reversed(rules):
        role = F.when(test, F.lit(chosen)).otherwise(role)
        rule = F.when(test, F.lit(why)).otherwise(rule)
    return profiles.withColumn("role", F.coalesce(role, F.lit("short_text"))).withColumn(
        "rule", F.coalesce(rule, F.lit("short values"))
    )


def catalog(roles: DataFrame) -> DataFrame:
    """One row per column with its role and five capabilities."""
    matrix = literal_frame(
        roles.sparkSession,
        [(role, *[c in has for c in CAPABILITIES]) for role, has in ROLE_CAPABILITIES.items()],
        [("role", "string"), *[(c, "boolean") for c in CAPABILITIES]],
    )
    return roles.join(F.broadcast(matrix), "role").select("column_id", "role", *CAPABILITIES)
