"""Findings, the records they cite, and the trail back to the raw rows.

A finding is one header row (finding_id, finding_type, claim, confidence,
confidence_reason, hypotheses).  What it cites is a separate long table,
(finding_id, evidence_type, position, record_id), because one finding may cite
a large part of the register and one record may be cited by many findings.

Ids are labels that submissions choose, so findings of several documents may
share one.  Where frames carry a ``finding_key`` as well, unique over all submissions, joins and
counts go by it; otherwise the id is taken as unique.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollbook.fixed import (
    CONFIDENCE_LEVELS,
    DEFAULT_CONFIDENCE_REASON,
    DEFAULT_FINDING_TYPE,
    FINDING_ID_FORMAT,
    NOT_NORMALIZED_MARKER,
    NULL_MARKER,
    REASON_COUNTER_OUTSIDE,
    REASON_EMPTY_CLAIM,
    REASON_NO_SUPPORT,
    REASON_SUPPORT_OUTSIDE,
    SHOWN_MISSING_IDS,
    SHOWN_SUPPORTING_IDS,
)
from rollbook.operators.joins import spread_join
from rollbook.operators.reduction import reduced_semi_join


KEY = "finding_key"


def _keys(df: DataFrame) -> list[str]:
    """What tells findings apart, and the label."""
    return [KEY, "finding_id"] if KEY in df.columns else ["finding_id"]


def coerce_confidence(confidence: Column) -> Column:
    """One of the three levels; anything else is medium."""
    return F.when(confidence.isin(CONFIDENCE_LEVELS), confidence).otherwise(F.lit("medium"))


def apply_defaults(findings: DataFrame, position: str) -> DataFrame:
    """Fill missing id, type, claim, confidence and reason of submitted findings.

    ``position`` is the 1-based place in the submission.
    """
    def given(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    return findings.withColumns({
        "finding_id": F.coalesce(given("finding_id"), F.format_string(FINDING_ID_FORMAT, F.col(position))),
        "finding_type": F.coalesce(given("type"), F.col("finding_type"), F.lit(DEFAULT_FINDING_TYPE)),
        "claim": F.coalesce("claim", F.lit("")),
        "confidence": coerce_confidence(F.col("confidence")),
        "confidence_reason": F.coalesce("confidence_reason", F.lit(DEFAULT_CONFIDENCE_REASON)),
    }).drop("type")


def fill_hypotheses(findings: DataFrame, by_finding: DataFrame) -> DataFrame:
    """Give findings without hypotheses those listed for their id: finding_id, hypotheses."""
    key = _keys(by_finding)[0] if KEY in findings.columns else "finding_id"
    listed = by_finding.select(key, F.col("hypotheses").alias("_listed"))
    own = F.when(F.size(F.coalesce("hypotheses", F.array().cast("array<string>"))) > 0, F.col("hypotheses"))
    return findings.join(listed, key, "left").withColumn("hypotheses", F.coalesce(own, "_listed")).drop("_listed")


def cited_records(findings: DataFrame) -> DataFrame:
    """The long citation table of findings that carry their ids as arrays."""
    cited = [
        findings.select(
            *_keys(findings), F.lit(kind).alias("evidence_type"),
            F.posexplode(f"{kind}_records").alias("position", "record_id"),
        )
        for kind in ("supporting", "counter")
    ]
    return cited[0].unionByName(cited[1])


def validate_findings(headers: DataFrame, cited: DataFrame, candidates: DataFrame) -> DataFrame:
    """Headers with citation counts, reasons for rejection, and ``accepted``.

    A finding needs a claim and a supporting record, and may cite only
    candidates.  ``candidates`` holds distinct ids in ``record_id``.
    """
    key = _keys(headers)[0]
    supporting, counter = F.col("evidence_type") == "supporting", F.col("evidence_type") == "counter"
    # a record cited by very many findings is split here by adaptive execution:
    # salting would repeat the whole candidate set
    known = candidates.select("record_id", F.lit(True).alias("inside"))
    checked = cited.join(known, "record_id", "left").withColumn("outside", F.col("inside").isNull())
    counts = checked.groupBy(key).agg(
        F.count_if(supporting).alias("n_supporting"),
        F.count_if(counter).alias("n_counter"),
        F.count_if(supporting & F.col("outside")).alias("supporting_outside"),
        F.count_if(counter & F.col("outside")).alias("counter_outside"),
    )
    first = W.partitionBy(key, "evidence_type").orderBy("position", "record_id")
    shown = (
        checked.filter("outside")
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= SHOWN_MISSING_IDS)
        .groupBy(key)
        .agg(*[
            F.concat_ws(", ", F.transform(
                F.sort_array(F.collect_list(F.when(kind, F.struct("rank", "record_id")))),
                lambda s: F.coalesce(F.concat(F.lit("'"), s["record_id"], F.lit("'")), F.lit("None")),
            )).alias(name)
            for kind, name in ((supporting, "_supporting"), (counter, "_counter"))
        ])
    )
    numbers = ["n_supporting", "n_counter", "supporting_outside", "counter_outside"]
    merged = headers.join(counts, key, "left").join(shown, key, "left").withColumns(
        {n: F.coalesce(n, F.lit(0)) for n in numbers}
    )
    reasons = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("claim"), F.lit("")).rlike(r"(?U)\S"), F.lit(REASON_EMPTY_CLAIM)),
        F.when(F.col("n_supporting") == 0, F.lit(REASON_NO_SUPPORT)),
        F.when(F.col("supporting_outside") > 0,
               F.format_string(REASON_SUPPORT_OUTSIDE, F.col("_supporting"), F.col("supporting_outside"))),
        F.when(F.col("counter_outside") > 0,
               F.format_string(REASON_COUNTER_OUTSIDE, F.col("_counter"), F.col("counter_outside"))),
    ))
    return (
        merged.withColumn("reasons", reasons)
        .withColumn("accepted", F.size("reasons") == 0)
        .drop("_supporting", "_counter")
    )


def finding_totals(validated: DataFrame) -> DataFrame:
    return validated.agg(
        F.count(F.lit(1)).alias("total_submitted"),
        F.count_if("accepted").alias("accepted_count"),
        F.count_if(~F.col("accepted")).alias("rejected_count"),
    )


def accepted_citations(validated: DataFrame, cited: DataFrame) -> DataFrame:
    """Citations of the accepted findings."""
    key = _keys(validated)[0]
    return spread_join(cited, validated.filter("accepted").select(key), [key], ["record_id"], "left_semi")


def evidence_index(cited: DataFrame) -> DataFrame:
    """Which findings use which record: each pair once, with the roles it plays.

    Sort by (record_id, finding_id) on output.  Pairs rather than id lists, so
    a record cited by everything stays spread over tasks.
    """
    return cited.groupBy("record_id", *_keys(cited)).agg(
        F.max(F.col("evidence_type") == "supporting").alias("is_supporting"),
        F.max(F.col("evidence_type") == "counter").alias("is_counter"),
    )


def evidence_records(index: DataFrame) -> DataFrame:
    """Each cited record once, with the number of findings that use it."""
    return index.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_findings"))


def insight_evidence(headers: DataFrame, cited: DataFrame) -> DataFrame:
    """One row per finding and cited record, with the finding's type and claim."""
    keys = _keys(headers)
    described = headers.select(keys[0], "finding_type", "claim")
    return spread_join(cited, described, [keys[0]], ["record_id"], "inner").select(
        *keys, "finding_type", "evidence_type", "record_id", "claim"
    )


def finding_summary(headers: DataFrame, cited: DataFrame, shown: int = SHOWN_SUPPORTING_IDS) -> DataFrame:
    """Counts per finding, the first few supporting ids, and whether there are more; the batches it comes from where headers name them."""
    keys = _keys(headers)
    batches = F.coalesce(F.array_join(F.array_sort(F.array_distinct("derived_batch_ids")), ", "), F.lit("")).alias("derived_batches")
    key = keys[0]
    supporting = F.col("evidence_type") == "supporting"
    counts = cited.groupBy(key).agg(
        F.count_if(supporting).alias("n_supporting"),
        F.count_if(~supporting).alias("n_counter"),
    )
    first = W.partitionBy(key).orderBy("position", "record_id")
    heads = (
        cited.filter(supporting)
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= shown)
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "record_id"))).alias("_head"))
    )
    zero = F.lit(0)
    return (
        headers.join(counts, key, "left")
        .join(heads, key, "left")
        .withColumn("n_supporting", F.coalesce("n_supporting", zero))
        .withColumn("n_counter", F.coalesce("n_counter", zero))
        .select(
            *keys, "finding_type", "claim", "confidence", *[c for c in ("confidence_reason",) if c in headers.columns],
            "n_supporting", "n_counter",
            F.coalesce(F.size(F.col("hypotheses")), zero).alias("n_hypotheses") if "hypotheses" in headers.columns
            else zero.alias("n_hypotheses"),
            F.coalesce(F.array_join(F.col("_head.record_id").cast("array<string>"), ", "), F.lit("")).alias("first_supporting"),
            (F.col("n_supporting") > shown).alias("has_more"),
            *[batches for c in ("derived_batch_ids",) if c in headers.columns],
        )
    )


def finding_hypotheses(headers: DataFrame) -> DataFrame:
    """One row per hypothesis, in the order given."""
    return headers.select(*_keys(headers), F.posexplode("hypotheses").alias("_at", "hypothesis")).select(
        *_keys(headers), (F.col("_at") + 1).alias("position"), "hypothesis"
    )


def counter_evidence(cited: DataFrame) -> DataFrame:
    """Finding and counter record pairs."""
    return cited.filter(F.col("evidence_type") == "counter").select(*_keys(cited), "record_id")


def evidence_appendix(
    raw: DataFrame, normalised: DataFrame, records: DataFrame, columns: Mapping[str, bool], id_column: str = "record_id",
) -> DataFrame:
    """One row per cited record and column: the raw text in full and the normalised label.

    ``columns`` maps column id to whether it is normalisable.  ``records`` is
    ``evidence_records``; which findings cite the record is in
    ``evidence_index``.  A missing value shows the NULL marker, an empty string
    stays empty.
    """
    def shown(value: Column) -> Column:
        return F.coalesce(F.replace(value, F.lit("\n"), F.lit("<br>")), F.lit(NULL_MARKER))

    def label(column: str) -> Column:
        names = [c for c in (f"{column}_label", column) if c in normalised.columns]
        return F.coalesce(*[F.col(n).cast("string") for n in names], F.lit(NULL_MARKER))

    labels = normalised.select(id_column, *[
        label(c).alias(f"n_{c}") for c, normalisable in columns.items() if normalisable
    ])
    # the cited rows of both sides first, so that few texts and labels move
    cited = reduced_semi_join(raw, records, id_column)
    paired = cited.join(records, id_column).join(reduced_semi_join(labels, records, id_column), id_column, "left")
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column_id"),
            shown(F.col(f"{c}_raw")).alias("raw_value"),
            (F.coalesce(F.col(f"n_{c}"), F.lit(NULL_MARKER)) if normalisable else F.lit(NOT_NORMALIZED_MARKER)).alias("normalized_value"),
        )
        for c, normalisable in columns.items()
    ])
    return paired.select(id_column, "source_file", "row_idx", "n_findings", F.inline(cells))
