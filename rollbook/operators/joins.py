"""Joins against a side with unique keys, safe for hot keys on the other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


# A looked-up table is broadcast only when counted within both bounds.
BROADCAST_ROWS_MAX = 200_000
BROADCAST_BYTES_MAX = 64 << 20


def fits_broadcast(rows: int, text_bytes: int) -> bool:
    return rows <= BROADCAST_ROWS_MAX and text_bytes <= BROADCAST_BYTES_MAX


def spread_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: Sequence[str], how: str = "left", salts: int = SALTS,
) -> DataFrame:
    """Join where a third of ``left`` may share one key.

    Rows of ``left`` scatter over ``salts`` parts by ``spread_by``; ``right``,
    unique on the keys and far smaller, is repeated once per part.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def lookup_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: Sequence[str], text_columns: Sequence[str], how: str = "left",
) -> DataFrame:
    """Join with a stored lookup table, unique on the keys: broadcast if it is counted as small, else spread."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text_columns), F.lit(0).cast("long"))
    n, width = right.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    if fits_broadcast(n, width):
        return left.join(F.broadcast(right), list(keys), how)
    return spread_join(left, right, keys, spread_by, how)
