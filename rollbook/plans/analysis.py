"""Phase two: retrieve candidates, count, pack, and close with checked findings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rollbook.fixed import (
    BATCH_BUDGET_CHARS,
    DEFAULT_PROJECTION,
    DEFAULT_SEARCH_COLUMNS,
    IDENTICAL_FIELDS_METRIC,
    SEARCH_COLUMN_NOT_SEARCHABLE,
    SEARCH_COLUMN_UNKNOWN,
    SUPERFICIAL_METRIC,
)
from rollbook.functions.predicates import all_of, check, condition
from rollbook.operators import evidence, gram_index, lessons, lexical, normalization, packing, quality, selection, statistics
from rollbook.plans.build import Register
from rollbook.session import literal_frame, materialise
from rollbook.sources import sinks

_ORDER_OPERATORS = ("lt", "lte", "gt", "gte", "between")


@dataclass
class Search:
    """Terms to look for: any term in any column.  ``indexed`` asks the register's trigram index first."""

    primary: Sequence[str]
    expanded: Sequence[str] = ()
    columns: Sequence[str] = tuple(DEFAULT_SEARCH_COLUMNS)
    indexed: bool = False


@dataclass
class Analysis:
    """One question's candidates and what follows from them.

    ``hits`` is the stored narrow table of the candidates; ``wanted`` the predicate that finds them in the
    register, None where a limit or judgments chose among its hits.
    """

    candidates: DataFrame
    hits: DataFrame
    trace: DataFrame
    distributions: DataFrame
    cross_tabs: DataFrame
    trends: DataFrame
    packed: DataFrame
    batches: DataFrame
    projection: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    judgments: DataFrame | None = None
    wanted: Column | None = None


def search_columns(register: Register, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """The columns to search and notes on the others: unknown ones are left out, those not meant for search are named."""
    notes = []
    for column in columns:
        if column not in register.roles:
            notes.append(SEARCH_COLUMN_UNKNOWN.format(column))
        elif column not in register.columns_with("searchable"):
            notes.append(SEARCH_COLUMN_NOT_SEARCHABLE.format(column))
    return [c for c in columns if c in register.roles], notes


def filter_column(register: Register, column: str, operator: str, value=None) -> Column:
    """A filter on a register column, its literal read the way the column is normalised."""
    role = register.roles[column]
    if column not in register.columns_with("filterable"):
        raise ValueError(f"column {column!r} is not filterable")
    dictionary = register.dictionaries.get(column, ())
    if role == "ordered_category" and operator in _ORDER_OPERATORS:
        return normalization.ordinal_condition(column, operator, value, dictionary)
    check(operator, value, role)
    if column in register.columns_with("normalizable") and operator in ("eq", "neq", "in", "not_in"):
        given = [value] if operator in ("eq", "neq") else list(value)
        meant = normalization.stored_literals(register.mappings, column, given, dictionary) if given else {}
        value = list(dict.fromkeys(i for v in given for i in meant[v]))
        operator = {"eq": "in", "neq": "not_in"}.get(operator, operator)
    numeric = role == "numeric" and operator not in ("is_null", "is_not_null")
    target = F.col(column).try_cast("double") if numeric else F.col(column)
    return condition(target, operator, value, role)


def analyse(
    register: Register, filters: Sequence[tuple] = (), search: Search | None = None, operation: str = "INTERSECT",
    limit: int | None = None, projection: Sequence[str] | None = None, budget: int = BATCH_BUDGET_CHARS,
    judgments: DataFrame | None = None, keep_uncertain: bool = False,
) -> Analysis:
    """Candidates of a question with their statistics and review batches.

    Both sides read one register, so the set algebra is one predicate over one
    scan.  That scan counts both sides and stores the candidates without their texts: ids, places, sizes,
    dimensions and dates.  Everything else reads the narrow table.  ``judgments`` (record_id, judgment, reason)
    drop candidates that an outside review found not to match.
    """
    table = register.normalised
    keep = F.coalesce(all_of(filter_column(register, *f) for f in filters), F.lit(False))
    notes: list[str] = []
    indexed = None
    if search is None:
        hit, operation = F.lit(True), "SQL_ONLY"
    else:
        columns, notes = search_columns(register, search.columns)
        terms = [*search.primary, *search.expanded]
        if search.indexed and columns and set(columns) <= set(register.indexed):
            indexed = materialise(gram_index.index_search(table, register.index, "record_id", columns, terms, clean=True), "found")
            hit = F.lit(False)  # comes from the index
        else:
            hit = lexical.term_hit(columns, terms, clean=True)
    hit = F.coalesce(hit, F.lit(False))

    def combined(keep: Column, hit: Column) -> Column:
        return {"INTERSECT": keep & hit, "UNION": keep | hit, "EXCEPT": keep & ~hit, "SQL_ONLY": keep, "FTS_ONLY": hit}[operation]

    shown = [c for c in (projection or DEFAULT_PROJECTION) if c in table.columns]
    sized = ["record_id", *[c for c in shown if c != "record_id"]]
    dimensions = register.columns_with("aggregatable")
    paired = [c for pair in statistics.default_pairs(table) for c in pair]
    dates = [c for c, role in register.roles.items() if role == "date"]
    narrow = dict.fromkeys(c for d in [*dimensions, *paired, *dates] for c in (d, f"{d}_label") if c in table.columns)
    seen = Observation()
    counts = {"sql_matched_count": F.count_if("_keep"), "fts_matched_count": F.count_if("_found"), "final_candidate_count": F.count_if("_wanted")}
    columns = [*dict.fromkeys(["record_id", "source_file", "row_idx", *narrow]), "rec_chars"]
    flagged = table.withColumns({"_keep": keep, "_found": hit, "rec_chars": packing.record_chars(sized)}).select(*columns, "_keep", "_found")
    if indexed is not None:  # rows have lost their texts before they meet the hits
        flagged = flagged.drop("_found").join(indexed.withColumn("_found", F.lit(True)), "record_id", "left").withColumn(
            "_found", F.coalesce("_found", F.lit(False)))
    hits = materialise(
        flagged.withColumn("_wanted", combined(F.col("_keep"), F.col("_found")))
        .observe(seen, *[c.alias(n) for n, c in counts.items()]).filter("_wanted").select(*columns), "hits")
    # the metrics come with the write; an empty table has none
    sides = {n: seen.get.get(n, 0) for n in counts}
    whole = limit is None and judgments is None
    if judgments is not None:
        judged = selection.semantic_filter(hits.select("record_id"), judgments, "record_id", keep_uncertain)
        hits = materialise(selection.restrict(hits, judged, "record_id"), "judged")
    if limit is not None:
        hits = materialise(selection.restrict(hits, selection.limit_ids(hits.select("record_id"), "record_id", limit), "record_id"), "limited")
    packed = materialise(packing.pack_batches(hits, "record_id", ["source_file", "row_idx", "record_id"], [], budget, size="rec_chars"), "packed")
    batches = packing.batch_summary(packed, "record_id")
    n_batches = packed.agg(F.coalesce(F.max("total_batches"), F.lit(0))).first()[0]
    trace = literal_frame(register.normalised.sparkSession, [(
        sides["sql_matched_count"], sides["fts_matched_count"], operation, sides["final_candidate_count"], n_batches)], [
        ("sql_matched_count", "long"), ("fts_matched_count", "long"), ("set_operation", "string"),
        ("final_candidate_count", "long"), ("batch_count", "long")])
    return Analysis(
        candidates=hits.select("record_id"),
        hits=hits,
        trace=trace,
        distributions=statistics.distributions(hits, dimensions),
        cross_tabs=statistics.cross_tabs(hits),
        trends=statistics.monthly_trend(hits, dates),
        packed=packed,
        batches=batches,
        projection=shown,
        notes=notes,
        judgments=judgments,
        wanted=combined(keep, hit) if whole and indexed is None else None,
    )


def complete(
    register: Register, analysis: Analysis, headers: DataFrame, cited: DataFrame, statuses: DataFrame, folder: str,
    ledger: DataFrame | None = None, analysis_type: str | None = None,
) -> dict[str, DataFrame]:
    """Check the findings, measure coverage, and store the evidence trail under ``folder``.

    ``headers`` and ``cited`` are the findings and the long table of what they
    cite (``split_findings`` makes both from a findings file); ``statuses`` has
    batch_index and status as reported by the review.  A ``ledger`` adds the lessons that apply.
    """
    validated = materialise(evidence.validate_findings(headers, cited, analysis.candidates))
    accepted = materialise(evidence.accepted_citations(validated, cited))
    index = evidence.evidence_index(accepted)
    records = evidence.evidence_records(index)
    normalisable = set(register.columns_with("normalizable"))
    results = {
        "coverage": packing.coverage(analysis.candidates, analysis.packed, statuses, "record_id"),
        "validated": validated,
        "totals": evidence.finding_totals(validated),
        "summary": evidence.finding_summary(validated.filter("accepted").select(*headers.columns), accepted),
        "hypotheses": evidence.finding_hypotheses(validated.filter("accepted")),
        "evidence_index": index,
        "insight_evidence": evidence.insight_evidence(validated, accepted),
        "appendix": evidence.evidence_appendix(
            register.raw, register.normalised, records, {c: c in normalisable for c in register.roles}
        ),
    }
    if ledger is not None:
        results["lessons"] = lessons.applicable_lessons(ledger, analysis_type)
    results["top_categories"] = statistics.top_categories(analysis.distributions)
    results["top_cross_cells"] = statistics.top_cross_cells(analysis.cross_tabs)
    if analysis.wanted is not None:  # the predicate again: texts are scanned, not shuffled
        sinks.write_csv(register.normalised.filter(analysis.wanted), f"{folder}/filtered-records")
    else:
        sinks.export_filtered(register.normalised, analysis.candidates, f"{folder}/filtered-records")
    if analysis.judgments is not None:
        sinks.export_judgments(analysis.judgments, f"{folder}/semantic-judgments")
    sinks.export_evidence_raw(register.raw, records, f"{folder}/evidence-raw")
    sinks.write_csv(results["insight_evidence"], f"{folder}/insight-evidence")
    sinks.export_statistics(analysis.distributions, f"{folder}/statistics")
    return results


def split_findings(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers and long citations of findings that carry their ids as arrays."""
    return findings.drop("supporting_records", "counter_records", "position"), evidence.cited_records(findings)


def audit(register: Register) -> DataFrame:
    """The data-quality audit of a whole register."""
    tests = {}
    if {"cause", "escape_cause"} <= set(register.roles):
        tests[IDENTICAL_FIELDS_METRIC] = quality.identical_fields("cause", "escape_cause")
    if "countermeasure" in register.roles:
        tests[SUPERFICIAL_METRIC] = quality.superficial("countermeasure")
    texts = [c for c, role in register.roles.items() if role in ("short_text", "long_text")]
    return quality.audit_summary(register.normalised, list(register.roles), texts, tests)


def landscape(register: Register) -> DataFrame:
    """Where the whole register concentrates, by phase and by type."""
    return statistics.landscape(register.normalised)
