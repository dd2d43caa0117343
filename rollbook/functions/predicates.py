"""Filter predicates over register columns.

A filter is ``(column, operator, value)``.  Each becomes one Column, so the
optimiser sees plain comparisons and pushes them to the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.fixed import ROLE_OPERATORS
from rollbook.functions.text import is_blank


def eq(column: Column, value) -> Column:
    return column == F.lit(value)


def neq(column: Column, value) -> Column:
    """Different from the value; NULL rows drop out."""
    return column != F.lit(value)


def is_in(column: Column, values: Sequence) -> Column:
    return column.isin(list(values))


def not_in(column: Column, values: Sequence) -> Column:
    """In none of the values; NULL rows drop out."""
    return ~column.isin(list(values))


def lt(column: Column, value) -> Column:
    return column < F.lit(value)


def lte(column: Column, value) -> Column:
    return column <= F.lit(value)


def gt(column: Column, value) -> Column:
    return column > F.lit(value)


def gte(column: Column, value) -> Column:
    return column >= F.lit(value)


def between(column: Column, bounds: Sequence) -> Column:
    """Inclusive at both ends."""
    return column.between(F.lit(bounds[0]), F.lit(bounds[1]))


def is_null(column: Column, value=None, text: bool = True) -> Column:
    """NULL, or for text also the empty string."""
    return is_blank(column) if text else column.isNull()


def is_not_null(column: Column, value=None, text: bool = True) -> Column:
    return (column.isNotNull() & (column != "")) if text else column.isNotNull()


def contains(column: Column, value: str) -> Column:
    """Literal substring: ``%`` and ``_`` mean themselves."""
    return column.contains(F.lit(value))


def starts_with(column: Column, value: str) -> Column:
    return column.startswith(value)


def ends_with(column: Column, value: str) -> Column:
    return column.endswith(value)


OPERATORS = {
    "eq": eq, "neq": neq, "in": is_in, "not_in": not_in,
    "lt": lt, "lte": lte, "gt": gt, "gte": gte, "between": between,
    "is_null": is_null, "is_not_null": is_not_null,
    "contains": contains, "starts_with": starts_with, "ends_with": ends_with,
}


def check(operator: str, value=None, role: str | None = None) -> None:
    """Reject an operator the role does not take, or a value of the wrong shape."""
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}")
    if role is not None and operator not in ROLE_OPERATORS[role]:
        raise ValueError(f"operator {operator!r} is incompatible with role {role!r}")
    if operator in ("in", "not_in"):
        if isinstance(value, str) or not isinstance(value, Sequence) or not value:
            raise ValueError(f"operator {operator!r} needs a non-empty list")
    elif operator == "between":
        if isinstance(value, str) or not isinstance(value, Sequence) or len(value) != 2:
            raise ValueError("operator 'between' needs [low, high]")
    elif operator not in ("is_null", "is_not_null"):
        if value is None or (isinstance(value, str) and not value.strip()):
            raise ValueError(f"operator {operator!r} needs a value")


def condition(column: Column | str, operator: str, value=None, role: str | None = None, text: bool = True) -> Column:
    """One filter as a Column.  ``text=False`` for columns that are not strings."""
    check(operator, value, role)
    column = F.col(column) if isinstance(column, str) else column
    if operator in ("is_null", "is_not_null"):
        return OPERATORS[operator](column, text=text)
    return OPERATORS[operator](column, value)


def all_of(conditions: Iterable[Column]) -> Column:
    """Conjunction; no condition keeps every row."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
