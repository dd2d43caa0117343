"""Tool calls in conversations: linked to results, ordered, validated, and written as canonical JSON.

Calls and results meet in a hash join on conversation and call id.  Repeated ids are
summed up before the join, so a group of any size is one row there: the first
call and the first result count, the others are counted.  Calls whose dependencies
come earlier in the transcript keep its order, which is a topological one; only
conversations with a dependency on a later call are ordered level by level.
Rows are numbered over range partitions, and meet their conversation's first number
by pieces of bounded length, so a very long conversation is neither sorted nor joined in one task.  Arguments are parsed as variants: their text form has sorted
keys and no white space.

Cases: arguments that are NULL or no JSON object are a problem and written as null;
a NULL id never links; repeated rows count as repeats; calls in or behind a cycle have no
position; a dependency on an unknown call is a problem; NULL turns come first; empty
tables give an empty result; columns besides those named are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.operators.numbering import number_rows
from rollbook.session import materialise


# log2 of the row numbers in a piece of a conversation.
PIECE_BITS = 12


@dataclass(frozen=True)
class Field:
    """A field of a tool's arguments; bounds hold for a number's value and a string's length."""

    name: str
    kind: str  # string, integer, number, boolean, object, array
    required: bool = True
    low: float | None = None
    high: float | None = None


Schemas = Mapping[str, Sequence[Field]]

_KINDS = {
    "string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "boolean": "^BOOLEAN$",
    "object": "^OBJECT", "array": "^ARRAY",
}


def _field_problem(value: Column, field: Field) -> Column:
    path = f"$.{field.name}"
    found = F.try_variant_get(value, path, "variant")
    kind = F.schema_of_variant(found)
    absent = found.isNull() | (kind == "VOID")
    size = F.length(F.try_variant_get(value, path, "string")) if field.kind == "string" else F.try_variant_get(value, path, "double")
    outside = F.lit(False)
    if field.low is not None:
        outside = outside | (size < field.low)
    if field.high is not None:
        outside = outside | (size > field.high)
    return (
        F.when(absent, F.lit(f"missing {field.name}") if field.required else F.lit(None).cast("string"))
        .when(~kind.rlike(_KINDS[field.kind]), F.lit(f"type {field.name}"))
        .when(F.coalesce(outside, F.lit(False)), F.lit(f"range {field.name}"))
    )


def problems(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted problems of a call's arguments; empty when they fit the tool's schema."""
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    chain = None
    for tool, fields in schemas.items():
        extra = F.transform(
            F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), F.array(*[F.lit(f.name) for f in fields])
                           if fields else F.array().cast("array<string>")), lambda k: F.concat(F.lit("unknown "), k))
        found = F.array_compact(F.array(*[_field_problem(value, f) for f in fields])) if fields else F.array().cast("array<string>")
        case = F.when(~is_object, F.array(F.lit("no object"))).otherwise(F.array_sort(F.concat(found, extra)))
        chain = F.when(name == tool, case) if chain is None else chain.when(name == tool, case)
    unknown = F.array(F.lit("unknown tool"))
    return unknown if chain is None else chain.otherwise(unknown)


def canonical(json: Column) -> Column:
    """A JSON text with sorted keys and without white space; NULL if it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with their results, and results without call.

    ``calls``: conv_id, turn, call_id, name, arguments, depends_on (array of ids);
    ``results``: conv_id, turn, call_id, content.
    """
    key = ["conv_id", "call_id"]
    first_call = calls.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_calls"), F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("call"))
    first_result = results.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_results"), F.min(F.struct("turn", "content")).alias("result"))
    # one row per id on both sides: a hash table of results, without a sort
    joined = first_call.join(first_result.hint("shuffle_hash"), key, "full")
    late = F.col("result.turn") <= F.col("call.turn")
    status = (
        F.when(F.col("call").isNull(), "orphan").when(F.col("result").isNull(), "unanswered")
        .when(F.coalesce(late, F.lit(False)), "early").otherwise("linked")
    )
    return joined.select(
        *key, F.coalesce("call.turn", "result.turn").alias("turn"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"),
        F.coalesce("call.depends_on", F.array().cast("array<string>")).alias("depends_on"), F.col("result.content").alias("content"),
        status.alias("status"), (F.coalesce("n_calls", F.lit(0)) + F.coalesce("n_results", F.lit(0))).alias("n_rows"))


def _levels(linked: DataFrame, edges: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)`` of the calls in conversations with a dependency on a later call; those in cycles are missing."""
    mixed = edges.filter("later").select("conv_id").distinct()
    waiting = materialise(edges.join(mixed, "conv_id").select("conv_id", "call_id", "needs"), "waiting")
    open_calls = materialise(linked.filter("status <> 'orphan'").join(mixed, "conv_id").select("conv_id", "call_id"), "open_calls")
    done = None
    level = 0
    while not open_calls.isEmpty():
        ready = open_calls.join(waiting.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
        ready = materialise(ready.withColumn("level", F.lit(level)), "ready")
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        open_calls = materialise(open_calls.join(ready, ["conv_id", "call_id"], "left_anti"), "open_calls")
        met = ready.select("conv_id", F.col("call_id").alias("needs"))
        waiting = materialise(waiting.join(met, ["conv_id", "needs"], "left_anti"), "waiting")
        level += 1
    return open_calls.withColumn("level", F.lit(0)).limit(0) if done is None else done


def _pieces(numbered: DataFrame) -> DataFrame:
    """``(_conv, _first, _piece)``: each conversation's first number, once per piece of the row numbers that it reaches into.

    A conversation's numbers are consecutive, so there are hardly more pieces than conversations.
    """
    ends = numbered.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("_number").alias("_first"), F.max("_number").alias("_end"))
    return ends.select("_conv", "_first", F.explode(
        F.sequence(F.shiftright("_first", PIECE_BITS), F.shiftright("_end", PIECE_BITS))).alias("_piece"))


def ordered(linked: DataFrame) -> DataFrame:
    """The linked rows with ``position`` in a topological order of their conversation, from 1, and ``n_missing`` dependencies.

    Calls come in the order of the transcript where that suits all dependencies; rows in cycles and orphans have no position.
    """
    linked = materialise(linked.withColumn("_row", F.xxhash64("conv_id", "call_id")), "linked")
    calls = linked.filter("status <> 'orphan' AND call_id IS NOT NULL").select("conv_id", F.col("call_id").alias("needs"), F.col("turn").alias("needs_turn"))
    needed = linked.select("conv_id", "call_id", "turn", F.explode("depends_on").alias("needs"))
    edges = materialise(needed.join(calls, ["conv_id", "needs"], "left").select(
        "conv_id", "call_id", "needs", F.col("needs_turn").isNull().alias("missing"),
        F.coalesce(F.col("needs_turn") >= F.col("turn"), F.lit(False)).alias("later")), "needs")
    missing = edges.filter("missing").groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n_missing"))
    levels = _levels(linked, edges.filter("NOT missing"))
    mixed = edges.filter("later").select("conv_id").distinct().withColumn("_mixed", F.lit(True))
    placed = (
        linked.join(missing, ["conv_id", "call_id"], "left").join(levels, ["conv_id", "call_id"], "left").join(mixed, "conv_id", "left")
        .withColumn("_cyclic", F.coalesce("_mixed", F.lit(False)) & F.col("level").isNull())
        .withColumn("_last", (F.col("status") == "orphan") | F.col("_cyclic")).withColumn("level", F.coalesce("level", F.lit(0)))
    )
    numbered = number_rows(placed, ["conv_id", "_last", "level", "turn", "call_id"], "_number")
    numbered = materialise(numbered, "numbered")
    own = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.shiftright("_number", PIECE_BITS) == F.col("_piece"))
    joined = numbered.join(_pieces(numbered), own, "left")
    return joined.withColumn("position", F.when(~F.col("_last"), F.col("_number") - F.col("_first") + 1)).withColumn(
        "n_missing", F.coalesce("n_missing", F.lit(0))).drop("_conv", "_piece", "_first", "_number", "_row", "_mixed", "_cyclic", "_last", "level")


def tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Linked, ordered and validated calls, each with its canonical ``message``."""
    rows = ordered(link(calls, results))
    faults = F.when(F.col("status") == "orphan", F.array().cast("array<string>")).otherwise(
        F.concat(problems(F.col("name"), F.col("arguments"), schemas),
                 F.when(F.col("n_missing") > 0, F.array(F.lit("missing dependency"))).otherwise(F.array().cast("array<string>"))))
    text = {c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1)
            for c in ("call_id", "name", "content")}
    pieces = [F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")), F.lit(',"id":'), text["call_id"],
              F.lit(',"name":'), text["name"], F.lit(',"result":'), text["content"], F.lit("}")]
    return rows.withColumn("problems", F.array_join(faults, "; ")).withColumn("valid", F.size(faults) == 0).withColumn(
        "message", reduce(lambda a, b: F.concat(a, b), pieces))
