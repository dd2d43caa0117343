"""The word rule all operators share: runs of characters other than space and U+0009 to U+000D."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"


def as_column(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def word_count(text: str | Column) -> Column:
    """How many words a text has; NULL has none."""
    bare = F.btrim(as_column(text), F.lit(SPACE))
    return F.when(bare.isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, SPACES))).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, though the body uses it often."""
    return F.transform(F.array(value), body)[0]
