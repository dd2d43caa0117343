"""Text cleaning, shape tests and rounding as column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that NFKC leaves alone and that never combine with a neighbour:
# ASCII and Latin letters; then general punctuation, kana, ideographs, Hangul.
# Text made only of these skips the Python hop.  A test checks every member.
LATIN_STABLE = r"\x00-\x7F\u00C0-\u0131"
NFKC_STABLE = LATIN_STABLE + (
    r"\u4E00-\u9FFF\u3041-\u3096\u30A0-\u30FE\u3001-\u3029\uAC00-\uD7A3"
    r"\u2012-\u2016\u2018-\u2023\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF"
)


# Length of a SHA-256, and of the longest distinct key.
KEY_BYTES = 32


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def nfkc(column: Column) -> Column:
    """Unicode NFKC.  Only text holding an unstable character leaves the JVM.

    The tests run from cheap to dear: byte length tells ASCII, one small
    character class tells Latin text, the full class decides the rest.
    """
    unstable = (
        (F.octet_length(column) != F.length(column))
        & column.rlike(f"[^{LATIN_STABLE}]")
        & column.rlike(f"[^{NFKC_STABLE}]")
    )
    return F.coalesce(_nfkc(F.when(unstable, column)), column)


def tidy_whitespace(column: Column) -> Column:
    """LF line ends, single spaces, no space at line or text ends; empty is NULL.

    Blank lines between paragraphs stay.  Text that is tidy already, by plain
    substring tests, is passed through without the rewriting.
    """
    untidy = reduce(lambda a, b: a | b, [
        *[column.contains(s) for s in ("\r", "\t", "  ", " \n", "\n ")],
        *[column.startswith(s) for s in (" ", "\n")],
        *[column.endswith(s) for s in (" ", "\n")],
    ])
    lines = F.regexp_replace(column, r"\r\n?", "\n")
    spaced = F.regexp_replace(lines, r"[ \t]+", " ")
    trimmed = F.btrim(F.regexp_replace(spaced, r" ?\n ?", "\n"), F.lit(" \n"))
    return F.nullif(F.when(untidy, trimmed).otherwise(column), F.lit(""))


def clean_text(column: Column) -> Column:
    """Mechanical cleaning: NFKC, then whitespace."""
    return tidy_whitespace(nfkc(column))


def search_shadow(column: Column) -> Column:
    """Lower-cased clean text, for matching only."""
    return F.lower(clean_text(column))


def fold_literal(value: str) -> str:
    """A name in a dictionary, whatever its case, width and spacing."""
    return " ".join(unicodedata.normalize("NFKC", value).split()).lower()


def fold_term(value: str) -> str:
    """``search_shadow`` for a search term: line breaks stay."""
    lines = re.sub(r"\r\n?", "\n", unicodedata.normalize("NFKC", value))
    return re.sub(r" ?\n ?", "\n", re.sub(r"[ \t]+", " ", lines)).strip(" \n").lower()


def is_blank(column: Column) -> Column:
    """NULL or the empty string.  For string columns."""
    return column.isNull() | (column == "")


def looks_like_date(column: Column) -> Column:
    """A year-month-day string (dash or slash, time allowed) naming a real day."""
    shaped = column.rlike(r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}([ T].*)?$")
    day = F.regexp_replace(F.substring_index(F.substring_index(column, " ", 1), "T", 1), "/", "-")
    return F.coalesce(shaped & day.try_cast("date").isNotNull(), F.lit(False))


def looks_like_number(column: Column) -> Column:
    """A plain decimal number, with sign or exponent."""
    return F.coalesce(column.rlike(r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"), F.lit(False))


def round_half_up(value: Column, digits: int) -> Column:
    """Round a non-negative double the way SQL engines round doubles.

    ``F.round`` goes through decimal and differs on binary ties.
    """
    scale = float(10 ** digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def percentage(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``, two decimals."""
    return round_half_up(part * F.lit(100.0) / whole, 2)


def any_contains(column: Column, terms: list[str]) -> Column:
    """True when the text holds any term, literally; NULL text holds none."""
    hits = [column.contains(F.lit(t)) for t in terms]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


def distinct_key(column: Column) -> Column:
    """A short binary stand-in for a string, equal exactly when the string is.

    Strings under 32 bytes stand for themselves, longer ones for their 32-byte
    SHA-256, so the two kinds never meet and long text is not shuffled.
    """
    raw = column.cast("binary")
    return F.when(F.octet_length(column) < KEY_BYTES, raw).otherwise(F.unhex(F.sha2(raw, 256)))
