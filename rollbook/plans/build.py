"""Phase one: from raw rows to a profiled, normalised, checked register."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.fixed import PHASES, ROLE_CAPABILITIES
from rollbook.functions.text import clean_text
from rollbook.operators import gram_index, normalization, profiling
from rollbook.operators.gram_index import GramIndex
from rollbook.operators.normalization import Dictionary
from rollbook.operators.validation import validate_build
from rollbook.sources import sinks

KEYS = ["record_id", "source_file", "row_idx"]


@dataclass
class Proposal:
    """What a reviewer looks at before the build is finished."""

    columns: list[str]
    clean: DataFrame
    profiles: DataFrame
    catalog: DataFrame
    mappings: DataFrame
    review_queue: DataFrame


@dataclass
class Register:
    """A finished build: stored tables and the role of each column."""

    raw: DataFrame
    normalised: DataFrame
    catalog: DataFrame
    mappings: DataFrame
    index: GramIndex | None
    findings: DataFrame
    roles: dict[str, str]
    dictionaries: Mapping[str, Dictionary]
    indexed: tuple[str, ...] = ()

    def columns_with(self, capability: str) -> list[str]:
        return [c for c, role in self.roles.items() if capability in ROLE_CAPABILITIES[role]]


def cleaned(raw: DataFrame) -> DataFrame:
    """The raw table with clean columns under their own names."""
    columns = [c.removesuffix("_raw") for c in raw.columns if c.endswith("_raw")]
    return raw.select(*KEYS, *[clean_text(F.col(f"{c}_raw")).alias(c) for c in columns])


def roles_of(catalog: DataFrame) -> dict[str, str]:
    """The catalog's roles.  One row per column, so it may come to the driver."""
    return {r["column_id"]: r["role"] for r in catalog.select("column_id", "role").collect()}


def propose(raw: DataFrame, folder: str, id_column: str | None = None, dictionary: Dictionary = tuple(PHASES)) -> Proposal:
    """Profile the columns and propose roles and value mappings.

    Clean rows and proposals are stored under ``folder``; edit the stored
    proposals, or pass others, before ``finalise``.
    """
    clean = sinks.write_table(cleaned(raw), f"{folder}/clean")
    columns = [c for c in clean.columns if c not in KEYS]
    profiles = sinks.write_table(profiling.profile_columns(clean, columns), f"{folder}/profiles")
    catalog = sinks.write_table(profiling.catalog(profiling.infer_roles(profiles, id_column)), f"{folder}/catalog")
    roles = roles_of(catalog)
    mapped = [c for c in columns if "normalizable" in ROLE_CAPABILITIES[roles[c]]]
    ordered = {c: dictionary for c in mapped if roles[c] == "ordered_category"}
    mappings = sinks.write_table(
        normalization.propose_mappings(normalization.value_counts(clean, mapped), ordered), f"{folder}/mappings"
    )
    return Proposal(columns, clean, profiles, catalog, mappings, normalization.review_queue(mappings))


def finalise(
    raw: DataFrame, proposal: Proposal, folder: str, accept_pending: bool = False, dictionary: Dictionary = tuple(PHASES),
    index: bool = False, exports: bool = True, buckets: int | None = None,
) -> Register:
    """Apply the accepted mappings; store both tables, the index, the checks and the CSV exports.

    The clean rows of the proposal are used as they are.  The trigram ``index`` is
    built on request, for registers that are searched very often: a scan finds the
    same.  Leave out the CSV ``exports`` where nobody reads them.  With ``buckets``, both tables are stored in so many
    by record id, and evidence is paired without a shuffle of texts.
    """
    found = roles_of(proposal.catalog)
    roles = {c: found[c] for c in proposal.columns}
    mappings = normalization.accept_pending(proposal.mappings) if accept_pending else proposal.mappings
    mapped = [c for c in proposal.columns if "normalizable" in ROLE_CAPABILITIES[roles[c]]]
    searched = [c for c in proposal.columns if roles[c] in ("short_text", "long_text")]

    def stored(table: DataFrame, name: str) -> DataFrame:
        if buckets:
            return sinks.write_bucketed(table, f"{folder}/{name}", "record_id", buckets)
        return sinks.write_table(table, f"{folder}/{name}")

    stored_raw = stored(raw, "raw")
    normalised = stored(normalization.apply_mappings(proposal.clean, mapped, mappings, "record_id"), "normalised")
    if searched and index:
        grams = gram_index.write_index(normalised, "record_id", searched, f"{folder}/index", clean=True)
        indexed = gram_index.indexed_ids(grams, "record_id")
    else:
        grams, indexed = None, normalised.select("record_id")
    checks = sinks.write_table(
        validate_build(
            stored_raw, normalised, indexed, "record_id", len(proposal.columns),
            [c for c in mapped if roles[c] == "ordered_category"],
        ),
        f"{folder}/checks",
    )
    if exports:
        sinks.export_build(normalised, proposal.catalog, mappings, checks, f"{folder}/exports")
    ordered = {c: dictionary for c in mapped if roles[c] == "ordered_category"}
    return Register(
        stored_raw, normalised, proposal.catalog, mappings, grams, checks, roles, ordered,
        tuple(searched) if index else ())
