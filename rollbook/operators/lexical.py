"""Substring search by scan.  ``gram_index`` answers the same from stored bitmaps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import fold_term, nfkc, search_shadow

# More terms than this are looked for as one pattern.
FEW_TERMS = 8


def fold_terms(terms: Sequence[str]) -> list[str]:
    folded = list(dict.fromkeys(fold_term(t) for t in terms))
    if not folded or "" in folded:
        raise ValueError("a search needs at least one term, none of them blank")
    return folded


def shadow(column: str, clean: bool) -> Column:
    """The text that terms are looked for in."""
    return F.lower(F.col(column)) if clean else search_shadow(F.col(column))


def _searched(column: str, clean: bool, spaced: bool) -> Column:
    """``shadow``, but white space is only tidied where a term holds any: other terms lie between it."""
    return shadow(column, clean) if clean or spaced else F.lower(nfkc(F.col(column)))


def terms_pattern(terms: Sequence[str]) -> str:
    """One pattern for any of the terms, shaped as a tree: equal beginnings are read once."""
    tree: dict = {}
    for term in sorted(terms, key=len):
        node = tree
        for c in term:
            if None in node:  # a shorter term has hit already
                break
            node = node.setdefault(c, {})
        else:
            node[None] = None

    def quoted(c: str) -> str:
        return c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):X}}}"

    def written(node: dict) -> str:
        if None in node:
            return ""
        branches = [quoted(c) + written(child) for c, child in sorted(node.items())]
        return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"

    return written(tree)


def _holds_any(text: Column, terms: Sequence[str]) -> Column:
    if len(terms) > FEW_TERMS:
        return text.rlike(terms_pattern(terms))
    return reduce(lambda a, b: a | b, [text.contains(F.lit(t)) for t in terms])


def _spaced(terms: Sequence[str]) -> bool:
    return any(c in t for t in terms for c in " \n")


def term_hit(columns: Sequence[str], terms: Sequence[str], clean: bool = False) -> Column:
    """Any term in any column, ignoring case, width and spacing on both sides.  Terms are literal text.

    ``clean`` says that the columns hold clean text already, which is then only lower-cased.
    """
    folded = fold_terms(terms)
    if not columns:
        return F.lit(False)
    lowered = [_searched(c, clean, _spaced(folded)) for c in columns]
    if len(folded) == 1 or len(folded) > FEW_TERMS:
        return reduce(lambda a, b: a | b, [F.coalesce(_holds_any(text, folded), F.lit(False)) for text in lowered])
    # with several terms, one array so that each text is lower-cased only once
    return F.coalesce(F.exists(F.array(*lowered), lambda text: _holds_any(text, folded)), F.lit(False))


def scan_search(df: DataFrame, id_column: str, columns: Sequence[str], terms: Sequence[str], clean: bool = False) -> DataFrame:
    """Ids of the rows hit, from one scan of the searched columns."""
    return df.filter(term_hit(columns, terms, clean)).select(id_column)


def expanded_search(
    df: DataFrame, id_column: str, columns: Sequence[str], primary: Sequence[str], expanded: Sequence[str],
) -> DataFrame:
    """Primary and expanded terms together, saying which list hit."""
    lists = {"hit_primary": fold_terms(primary) if primary else [], "hit_expanded": fold_terms(expanded) if expanded else []}
    spaced = _spaced([t for terms in lists.values() for t in terms])
    texts = F.array(*[_searched(c, False, spaced) for c in columns])

    def hits(text: Column) -> Column:
        return F.struct(*[
            F.coalesce(_holds_any(text, terms), F.lit(False)).alias(name) if terms else F.lit(False).alias(name) for name, terms in lists.items()])

    # each text is folded once for both lists
    found = df.select(id_column, F.transform(texts, hits).alias("_hits"))
    flags = found.select(id_column, *[F.array_contains(F.col(f"_hits.{name}"), F.lit(True)).alias(name) for name in lists])
    return flags.filter(F.col("hit_primary") | F.col("hit_expanded"))
