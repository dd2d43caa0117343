"""Mixing sources to target weights without sorting documents.

Every document has a 60-bit hash.  A source that may take a fraction of its
words once more takes the documents whose hash is below a threshold.  The
threshold comes from histograms: words summed by source and hash bucket, then
again inside the one bucket where the budget ends, a few levels deep.  What
the whole documents below the threshold leave unused is filled the same way
from the documents small enough to fit.  At the end a document's copies follow
from its own hash and size and its source's thresholds, so documents are
filtered and never sorted or collected.

Cases: a NULL text has no words; a NULL source is a source of its own, after all
others; documents without words take nothing; equal rows have equal hashes and
are taken or left together; an empty table gives an empty result.  Columns that
the caller has besides are untouched; names with the prefix ``_mix_`` are ours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollbook.llm.words import word_count
from rollbook.operators.joins import spread_join
from rollbook.session import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
LEVEL_BITS = 12
LEVELS = 3
HASH_BITS = LEVEL_BITS * LEVELS
FILLS = 2


def hash_of(id_column: str, text_column: str) -> Column:
    """The leading 36 bits of an md5 over id and text, the same in every run and engine."""
    key = F.concat(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.md5(F.col(text_column)), F.lit(""))
    )
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``target`` words for each row of (source, source_size).

    Weights repeat over the sources in code point order, NULL last.  A source
    gets least(most * size, weight * level), where level is the one at which all
    targets add up to ``share`` times all sizes.  Ordered by their caps, the
    level is the largest of (budget - caps before) / (weights from here on).
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    cap = F.lit(most) * F.col("source_size")
    by_ratio = W.orderBy(F.col("_cap") / F.col("_weight"), "_place")
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weighed = sources.withColumn("_place", place).withColumn("_weight", weight).withColumn("_cap", cap)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    before = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = F.max("_level").over(everything)
    return (
        weighed.withColumn("_level", (budget - before) / rest)
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_weight") * level))
        .drop("_place", "_weight", "_cap", "_level")
    )


def _cut(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per key the first hash prefix at which the running sum of sizes passes the gap.

    ``rows``: key, h, size; ``gaps``: key, gap.  Gives key, ``cut`` (take hashes
    below it), ``left`` (the gap that stays) and ``unit`` (words at the cut
    itself).  Each level reads only the boundary bucket of the one before.
    """
    at = gaps.select("key", F.col("gap").alias("left"), F.lit(0).cast("long").alias("cut"), F.lit(0).cast("long").alias("unit"))
    done = F.lit(1 << HASH_BITS)
    for level in range(LEVELS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        bucket = F.shiftright("h", shift)
        inside = spread_join(rows, at, ["key"], ["h", "size"], "inner")
        if level:
            inside = inside.filter(F.shiftright("h", shift + LEVEL_BITS) == F.shiftright("cut", shift + LEVEL_BITS))
        histogram = inside.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        running = F.sum("words").over(W.partitionBy("key").orderBy("bucket"))
        passed = (
            histogram.withColumn("upto", running).join(at.select("key", "left"), "key").filter(F.col("upto") > F.col("left"))
            .groupBy("key").agg(F.min(F.struct("bucket", "words", "upto")).alias("b"))
        )
        taken = histogram.groupBy("key").agg(F.sum("words").alias("all_words"))
        at = materialise(
            at.join(passed, "key", "left").join(taken, "key", "left").select(
                "key",
                F.when(F.col("cut") >= done, F.col("left"))
                .when(F.col("b").isNull(), F.col("left") - F.coalesce("all_words", F.lit(0)))
                .otherwise(F.col("left") - (F.col("b.upto") - F.col("b.words"))).alias("left"),
                F.when(F.col("b").isNull(), done).otherwise(F.shiftleft(F.col("b.bucket"), shift)).alias("cut"),
                F.coalesce(F.col("b.words"), F.lit(0)).alias("unit"),
            ), "mix_cut",
        )
    return at


def mixing_plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: size, target, whole copies and the thresholds for one copy more.

    ``rows``: source, key (never NULL, one per source), h, size.
    """
    sources = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    size, target = F.col("source_size"), F.col("target")
    plan = materialise(
        source_targets(sources, weights, share, most)
        .withColumn("whole", F.when(size > 0, F.least(F.floor(target / size), F.lit(most))).otherwise(0).cast("long"))
        .withColumn("gap", F.when(F.col("whole") >= most, 0.0).otherwise(target - F.col("whole") * size)), "mix_plan",
    )
    gaps = plan.select("key", "gap")
    some = rows.filter("size > 0")
    for fill in range(FILLS + 1):
        at = _cut(some, gaps)
        if fill == FILLS:  # the unit at the last cut, if that is nearer
            over = (F.col("unit") > 0) & (F.col("unit") <= 2 * F.col("left"))
            at = at.withColumn("cut", F.when(over, F.col("cut") + 1).otherwise(F.col("cut")))
        names = [F.col("left").alias(f"left_{fill}"), F.col("cut").alias(f"cut_{fill}")]
        plan = plan.join(at.select("key", *names), "key")
        if fill < FILLS:
            gaps = at.select("key", F.col("left").alias("gap"))
            fits = at.select("key", F.col("left").alias("_left"), F.col("cut").alias("_cut"))
            some = spread_join(some, fits, ["key"], ["h", "size"], "inner").filter("h >= _cut AND size <= _left").drop("_left", "_cut")
    return materialise(plan, "mix_plan")


def _more() -> Column:
    """Whether a document is taken once more than its whole source."""
    taken = F.col("_mix_h") < F.col("cut_0")
    for fill in range(1, FILLS + 1):
        taken = taken | ((F.col("_mix_size") <= F.col(f"left_{fill - 1}")) & (F.col("_mix_h") < F.col(f"cut_{fill}")))
    return taken


def mix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, keep: Sequence[str] | None = None,
) -> DataFrame:
    """The documents with ``_mix_size``, ``_mix_source_size``, ``_mix_target`` and ``_mix_copies``.

    ``keep`` names the columns to carry besides (all by default); without the
    text among them the stored table of sizes and hashes answers alone.
    """
    keep = docs.columns if keep is None else list(keep)
    source = F.col(source_column).cast("string")
    narrow = docs.withColumn("_mix_size", word_count(text_column)).withColumn("_mix_h", hash_of(id_column, text_column)).withColumn(
        "_mix_key", F.coalesce(F.concat(F.lit("="), source), F.lit(""))).withColumn("_mix_source", source)
    own = ["_mix_key", "_mix_source", "_mix_h", "_mix_size"]
    stored = materialise(narrow.select(*[c for c in keep if c != text_column], *own), "mix_rows")
    plan = mixing_plan(stored.select(*[F.col(c).alias(c.removeprefix("_mix_")) for c in own]), weights, share, most)
    copies = F.col("whole") + _more().cast("long")
    sides = plan.select(
        F.col("key").alias("_mix_key"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"),
        F.col("whole"), *[F.col(f"{n}_{i}") for n in ("left", "cut") for i in range(FILLS + 1)],
    )
    clash = {c: f"_mix_kept_{c}" for c in keep if c in sides.columns}
    rows = (narrow if text_column in keep else stored).select(*[F.col(c).alias(clash.get(c, c)) for c in keep], *own)
    joined = spread_join(rows, sides, ["_mix_key"], ["_mix_h", "_mix_size"], "inner")
    copies = F.when(F.col("whole") >= most, F.col("whole")).otherwise(copies).alias("_mix_copies")
    return joined.select(
        *[F.col(clash.get(c, c)).alias(c) for c in keep], "_mix_size", "_mix_source_size", "_mix_target", copies)
