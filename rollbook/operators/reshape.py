"""Wide rows to (name, value) cells."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame

from rollbook.session import literal_frame


def cells(df: DataFrame, values: Mapping[str, Column], name: str, value: str) -> DataFrame:
    """One row per input row and named expression, the value as a string; none for no expression."""
    if not values:
        return literal_frame(df.sparkSession, [], [(name, "string"), (value, "string")])
    texts = df.select(*[expr.cast("string").alias(key) for key, expr in values.items()])
    return texts.unpivot([], list(values), name, value)
