"""Value dictionaries, mapping proposals and their application.

A dictionary is a list ``(canonical_id, label, ordinal, aliases)`` in the
program, or a table with these columns, of any size.  A value map is a table with
one row per column and raw value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.fixed import MATCHED, UNKNOWN_VALUE_PREFIX, UNMATCHED
from rollbook.functions.predicates import check, condition
from rollbook.functions.text import clean_text, distinct_key, fold_literal, round_half_up, search_shadow
from rollbook.operators.joins import fits_broadcast, lookup_join, spread_join
from rollbook.operators.reshape import cells
from rollbook.operators.similarity import nearest_names
from rollbook.session import literal_frame, materialise

Items = Sequence[tuple[str, str, int, Sequence[str]]]
Dictionary = Items | DataFrame
# So few dictionary names are compared with every value in place.
FEW_NAMES = 32


def alias_table(dictionary: Items) -> dict[str, tuple[str, str, int]]:
    """Folded label or alias -> (canonical id, label, ordinal); the first item wins."""
    table: dict[str, tuple[str, str, int]] = {}
    for canonical_id, label, ordinal, aliases in dictionary:
        for name in [label, *aliases]:
            table.setdefault(fold_literal(name), (canonical_id, label, ordinal))
    return table


def alias_frame(spark: SparkSession, dictionary: Dictionary) -> DataFrame:
    """``(alias, canonical_id, canonical_label, ordinal)``, once per folded label or alias.

    In a table the item with the smallest ordinal wins a shared name, then the smallest id.
    """
    if not isinstance(dictionary, DataFrame):
        rows = [(alias, *target) for alias, target in alias_table(dictionary).items()]
        return literal_frame(
            spark, rows, [("alias", "string"), ("canonical_id", "string"), ("canonical_label", "string"), ("ordinal", "int")])
    none = F.array().cast("array<string>")
    names = F.concat(F.array("label"), F.coalesce("aliases", none))
    items = dictionary.select(
        F.explode(names).alias("name"),
        F.struct(F.col("ordinal").cast("int").alias("ordinal"), "canonical_id", F.col("label").alias("canonical_label")).alias("item"),
    ).select(search_shadow(F.col("name")).alias("alias"), "item")
    return materialise(items.filter("alias IS NOT NULL").groupBy("alias").agg(F.min("item").alias("item")).select(
        "alias", "item.canonical_id", "item.canonical_label", "item.ordinal"), "dictionary")


_NAMED = ["alias", "canonical_id", "canonical_label"]


def resolve(df: DataFrame, column: str, dictionary: Dictionary) -> DataFrame:
    """Add canonical id, label and ordinal of a value named by label or alias.

    Case, width and spacing do not matter.  Unknown values get NULLs.
    """
    lookup = alias_frame(df.sparkSession, dictionary)
    keyed = df.withColumn("alias", search_shadow(F.col(column)))
    plain = [c for c, t in keyed.dtypes if not t.startswith(("map", "variant"))]
    return lookup_join(keyed, lookup, ["alias"], plain, _NAMED).drop("alias")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values with their number of records, all columns from one scan."""
    return (
        cells(df, {c: F.col(c) for c in columns}, "column_id", "raw_value")
        .filter(F.col("raw_value") != "")
        .groupBy("column_id", "raw_value")
        .agg(F.count(F.lit(1)).alias("n_records"))
    )


def propose_mappings(counts: DataFrame, dictionaries: Mapping[str, Dictionary]) -> DataFrame:
    """A mapping per distinct value: the dictionary's, or an id made from the value.

    ``dictionaries`` maps a column id to the dictionary that governs it.
    """
    spark = counts.sparkSession
    lookup = literal_frame(spark, [], [
        ("column_id", "string"), ("alias", "string"), ("canonical_id", "string"), ("canonical_label", "string"), ("ordinal", "int")])
    for column, dictionary in dictionaries.items():
        lookup = lookup.unionByName(alias_frame(spark, dictionary).withColumn("column_id", F.lit(column)))
    keyed = counts.withColumn("alias", search_shadow(F.col("raw_value")))
    joined = lookup_join(keyed, lookup, ["column_id", "alias"], ["raw_value"], _NAMED).withColumnsRenamed(
        {"canonical_id": "_id", "canonical_label": "_label"})
    known = F.col("_id").isNotNull()
    matched_confidence, matched_source, matched_reason = MATCHED
    unmatched_confidence, unmatched_source, unmatched_reason = UNMATCHED
    return joined.select(
        "column_id",
        "raw_value",
        F.coalesce("_id", F.concat(F.lit(UNKNOWN_VALUE_PREFIX), F.lower("raw_value"))).alias("canonical_id"),
        F.coalesce("_label", "raw_value").alias("canonical_label"),
        "ordinal",
        F.when(known, "accepted").otherwise("pending").alias("status"),
        F.when(known, matched_confidence).otherwise(unmatched_confidence).alias("confidence"),
        F.when(known, matched_source).otherwise(unmatched_source).alias("source"),
        F.when(known, F.format_string(matched_reason, F.col("_label"))).otherwise(unmatched_reason).alias("reason"),
        "n_records",
    )


def review_queue(mappings: DataFrame) -> DataFrame:
    """Values no dictionary knows.  Order by ``n_records`` descending to review."""
    return mappings.filter(F.col("source") == UNMATCHED[1]).select("column_id", "raw_value", "n_records")


def accept_pending(mappings: DataFrame) -> DataFrame:
    """Promote every pending mapping."""
    return mappings.withColumn("status", F.when(F.col("status") == "pending", "accepted").otherwise(F.col("status")))


def similar_values(values: DataFrame, column: str, dictionary: Dictionary, min_similarity: float = 0.5) -> DataFrame:
    """The closest dictionary name for each value, by edit distance over length.

    The values are folded and stored first, so that each is scored once.  A handful of names are
    scored in place, more are joined by what they share (``similarity``).  Ties go to the name that sorts first.
    """
    names = materialise(alias_frame(values.sparkSession, dictionary), "names")
    total = names.count()
    if not total:
        raise ValueError("the dictionary has no names")
    folded = materialise(values.withColumn("_folded", search_shadow(F.col(column))).filter(F.col("_folded").isNotNull()), "folded")
    texts = folded.select(F.col("_folded").alias("text")).distinct()
    if total > FEW_NAMES and min_similarity > 0:
        best, _ = nearest_names(materialise(texts, "texts"), names.select(F.col("alias").alias("text")), min_similarity)
    else:
        best = _among_few(texts, names, total)
    targets = names.select(F.col("alias").alias("name"), "canonical_id", "canonical_label")
    scored = lookup_join(
        best.withColumn("similarity", round_half_up(F.lit(1.0) - F.col("distance"), 4)).filter(F.col("similarity") >= min_similarity),
        targets, ["name"], ["text"], ["name", "canonical_id", "canonical_label"], "inner")
    return folded.join(scored.withColumnRenamed("text", "_folded"), "_folded").select(
        *values.columns, F.col("name").alias("similar_name"), "canonical_id", "canonical_label", "similarity")


def _among_few(texts: DataFrame, names: DataFrame, total: int) -> DataFrame:
    """``(text, distance, name)``: the nearest of all names, which stand in arrays of bounded size, several for a dictionary any name of which will do."""
    blocks = -(-total // FEW_NAMES)
    choices = names.groupBy(F.pmod(F.xxhash64("alias"), F.lit(blocks)).alias("_block")).agg(F.collect_list("alias").alias("_names"))
    met = texts.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(choices, "_block")

    def scored(name: Column) -> Column:
        longer = F.greatest(F.length("text"), F.length(name))
        return F.struct((F.levenshtein(F.col("text"), name) / longer).alias("distance"), name.alias("name"))

    best = met.select("text", F.array_min(F.transform("_names", scored)).alias("best"))
    return best.groupBy("text").agg(F.min("best").alias("best")).select("text", "best.distance", "best.name")


def apply_mappings(df: DataFrame, columns: Sequence[str], mappings: DataFrame, id_column: str) -> DataFrame:
    """Replace each column by canonical id and add its label and ordinal.

    Only accepted mappings apply; a value without one keeps its text as id and
    label.  NULL stays NULL.  The map is measured per column, in one job, before
    anything is broadcast; a value with two accepted mappings is refused.
    Columns with larger maps are looked up in a narrow long table, their hot
    values spread out, which joins the whole rows once.
    """
    columns = list(columns)
    accepted = mappings.filter(F.col("column_id").isin(columns) & (F.col("status") == "accepted")).select(
        "column_id", F.col("raw_value").alias("_raw"), F.col("canonical_id").alias("_id"), F.col("canonical_label").alias("_label"),
        F.col("ordinal").alias("_ordinal"))
    small = _small_maps(accepted)
    large = [c for c in columns if c not in small]
    out = df
    if large:
        mapped = F.struct("_id", "_label", "_ordinal")
        keyed = df.withColumn("_key", F.xxhash64(id_column, *large))
        cell = F.explode(F.array(*[F.struct(F.lit(c).alias("column_id"), F.col(c).cast("string").alias("_raw")) for c in large]))
        long = keyed.select("_key", cell.alias("_cell")).select("_key", "_cell.*").filter("_raw IS NOT NULL")
        found = spread_join(long, accepted, ["column_id", "_raw"], ["_key"], "inner").groupBy("_key").agg(*[
            F.max(F.when(F.col("column_id") == c, mapped)).alias(f"_map_{i}") for i, c in enumerate(large)])
        out = keyed.join(found, "_key", "left").drop("_key")
    for i, column in enumerate(large):
        out = _mapped(out.withColumn("_raw", F.col(column).cast("string")).withColumns(
            {n: F.col(f"_map_{i}")[n] for n in ("_id", "_label", "_ordinal")}).drop(f"_map_{i}"), column)
    for column in small & set(columns):
        lookup = accepted.filter(F.col("column_id") == column).drop("column_id")
        out = _mapped(out.withColumn("_raw", F.col(column).cast("string")).join(F.broadcast(lookup), "_raw", "left"), column)
    return out.select(*df.columns, *[c for column in columns for c in (f"{column}_label", f"{column}_ordinal")])


def _mapped(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns({
        column: F.coalesce("_id", "_raw"),
        f"{column}_label": F.coalesce("_label", "_raw"),
        f"{column}_ordinal": F.col("_ordinal"),
    }).drop("_raw", "_id", "_label", "_ordinal")


def _small_maps(accepted: DataFrame) -> set[str]:
    """Columns whose map may be broadcast.  One row per column reaches the driver."""
    size = F.octet_length("_raw") + F.octet_length("_id") + F.octet_length("_label")
    measured = accepted.groupBy("column_id").agg(
        F.count("_raw").alias("n"), F.count_distinct("_raw").alias("values"), F.sum(size).alias("bytes")).collect()
    if repeated := [r["column_id"] for r in measured if r["n"] > r["values"]]:
        raise ValueError(f"values with several accepted mappings in {sorted(repeated)}")
    return {r["column_id"] for r in measured if fits_broadcast(r["n"], r["bytes"] or 0)}


def stored_literals(mappings: DataFrame, column: str, values: Sequence[str], dictionary: Dictionary = ()) -> dict[str, list[str]]:
    """What filter literals mean in a column normalised by this map: a list of stored values for each.

    An id of the map stands for itself; else a raw value or label of the map, or
    a name in the dictionary, stands for its id; else the text stands for itself, as
    values without an accepted mapping keep theirs.  Only ids for the given literals reach the driver.
    """
    folded = {v: fold_literal(v) for v in values}
    literals = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(f).alias("folded")) for v, f in folded.items()])
    accepted = mappings.filter((F.col("column_id") == column) & (F.col("status") == "accepted")).select(
        "canonical_id", search_shadow(F.col("raw_value")).alias("_raw"), search_shadow(F.col("canonical_label")).alias("_label"))
    meant = F.filter(literals, lambda x: (F.col("canonical_id") == x.value) | (F.col("_raw") == x.folded) | (F.col("_label") == x.folded))
    hits = accepted.select("canonical_id", F.explode(meant).alias("x")).select(F.col("x.value").alias("value"), "canonical_id").distinct().collect()
    found: dict[str, list[str]] = {}
    for r in sorted(hits, key=lambda r: r["canonical_id"]):
        found.setdefault(r["value"], []).append(r["canonical_id"])
    named = named_items(dictionary, [v for v in values if v not in found])
    return {v: [v] if v in found.get(v, ()) else found.get(v) or ([named[v][0]] if v in named else [v]) for v in values}


def named_items(dictionary: Dictionary, values: Sequence[str]) -> dict[str, tuple[str, str, int]]:
    """The item (id, label, ordinal) that each text names: by id, else by folded label or alias.  Texts that name none are left out.

    A table is filtered for the given texts; one row per text reaches the driver.  Where items share a name,
    the first of a list wins, of a table the one with the smallest ordinal, then id.
    """
    folded = {v: fold_literal(v) for v in values}
    if not folded:
        return {}
    if isinstance(dictionary, DataFrame):
        names = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
        items = dictionary.select(
            F.explode(names).alias("name"), F.struct(F.col("ordinal").cast("int").alias("ordinal"), "canonical_id", "label").alias("item"))
        wanted = {"id": (F.col("item.canonical_id"), list(folded)), "name": (search_shadow(F.col("name")), list(set(folded.values())))}
        hits = reduce(DataFrame.unionByName, [
            items.select(F.lit(kind).alias("kind"), key.alias("key"), "item").filter(F.col("key").isin(given)) for kind, (key, given) in wanted.items()])
        best = hits.groupBy("kind", "key").agg(F.min("item").alias("item")).select("kind", "key", "item.*").collect()
        by = {(r["kind"], r["key"]): (r["canonical_id"], r["label"], r["ordinal"]) for r in best}
    else:
        by = {("name", name): item for name, item in alias_table(dictionary).items()}
        by |= {("id", item[0]): tuple(item[:3]) for item in reversed(list(dictionary))}
    found = {v: by.get(("id", v)) or by.get(("name", f)) for v, f in folded.items()}
    return {v: item for v, item in found.items() if item is not None}


def dictionary_mappings(spark: SparkSession, column: str, dictionary: Dictionary) -> DataFrame:
    """A ready-made value map from a dictionary, for columns whose raw values are its names."""
    if isinstance(dictionary, DataFrame):
        names = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
        item = F.struct(F.col("ordinal").cast("int").alias("ordinal"), "canonical_id", F.col("label").alias("canonical_label"))
        items = dictionary.select(F.explode(names).alias("raw_value"), item.alias("item")).filter("raw_value IS NOT NULL")
        return items.groupBy("raw_value").agg(F.min("item").alias("item")).select(
            F.lit(column).alias("column_id"), "raw_value", "item.canonical_id", "item.canonical_label", "item.ordinal", F.lit("accepted").alias("status"))
    rows = []
    seen = set()
    for canonical_id, label, ordinal, aliases in dictionary:
        for name in [label, *aliases]:
            if name not in seen:
                seen.add(name)
                rows.append((column, name, canonical_id, label, ordinal, "accepted"))
    return literal_frame(spark, rows, [
        ("column_id", "string"), ("raw_value", "string"), ("canonical_id", "string"),
        ("canonical_label", "string"), ("ordinal", "int"), ("status", "string"),
    ])


def canonical_literal(value: str, dictionary: Dictionary = ()) -> str:
    """The canonical id a filter literal means: an id, a label, an alias or an unknown value."""
    if value.startswith(UNKNOWN_VALUE_PREFIX):
        return value
    hit = named_items(dictionary, [value]).get(value)
    return hit[0] if hit else UNKNOWN_VALUE_PREFIX + value.lower()


def ordinal_literals(values: Sequence[int | str], dictionary: Dictionary) -> list[int]:
    """The ordinals that literals mean: numbers, ids, labels or aliases."""
    named = named_items(dictionary, [v for v in values if isinstance(v, str) and not v.isdigit()])
    out = []
    for value in values:
        if isinstance(value, int) or value.isdigit():
            out.append(int(value))
        elif value in named and named[value][2] is not None:
            out.append(named[value][2])
        else:
            raise ValueError(f"{value!r} names nothing in the dictionary")
    return out


def ordinal_literal(value: int | str, dictionary: Dictionary) -> int:
    return ordinal_literals([value], dictionary)[0]


def ordinal_condition(column: str, operator: str, value, dictionary: Dictionary) -> Column:
    """Compare an ordered category by position, whatever way the bound is written."""
    check(operator, value, "ordered_category")
    bound = ordinal_literals(value, dictionary) if operator == "between" else ordinal_literal(value, dictionary)
    return condition(f"{column}_ordinal", operator, bound)


def raw_preserved(raw: DataFrame, normalised: DataFrame, id_column: str, columns: Sequence[str]) -> DataFrame:
    """Per text column: records, those equal to the cleaned raw text, those equal to it verbatim.

    Texts meet as short keys that are equal exactly when the texts are, so the
    join moves no long text.
    """
    cleaned = raw.select(id_column, *[
        text for c in columns for text in (F.col(f"{c}_raw"), clean_text(F.col(f"{c}_raw")).alias(f"clean_{c}"))
    ])
    before = cleaned.select(id_column, *[
        key for c in columns for key in (
            distinct_key(F.col(f"clean_{c}")).alias(f"clean_{c}"), distinct_key(F.col(f"{c}_raw")).alias(f"raw_{c}"),
        )
    ])
    after = normalised.select(id_column, *[distinct_key(F.col(c)).alias(c) for c in columns])
    tests = F.array(*[
        F.struct(
            F.lit(c).alias("column_id"),
            F.col(c).eqNullSafe(F.col(f"clean_{c}")).alias("kept"),
            F.col(c).eqNullSafe(F.col(f"raw_{c}")).alias("verbatim"),
        )
        for c in columns
    ])
    return before.join(after, id_column).select(F.inline(tests)).groupBy("column_id").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if("kept").alias("n_preserved"),
        F.count_if("verbatim").alias("n_verbatim"),
    )
