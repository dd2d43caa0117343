"""Packing records, in source order, into batches of bounded size.

The rule is next-fit: a record opens a new batch when the current one would
exceed the budget with it.  Every batch start depends on the one before, so the
register is cut into blocks of consecutive source rows and each block is
summed up as a small function: given the characters already in the open batch
when the block begins, how many batches does the block open and how full is the
last one?  That answer depends only on the first row to open a batch, and as
every record costs at least the overhead there are at most
``budget / overhead + 1`` candidates for it.  Functions of neighbouring blocks
compose, so a two-level tree carries the state from the start of the register
to each block, and the blocks then number their rows independently.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.fixed import BATCH_BUDGET_CHARS, BATCH_ID_FORMAT, RECORD_OVERHEAD_CHARS
from rollbook.functions.text import percentage
from rollbook.operators.numbering import number_rows

BLOCK_ROWS = 1 << 16
FAN_IN = 1 << 12

# A block's function.  Entering with c characters in the open batch, the first
# i with reach[i] > budget - c opens a batch; from there the block opens
# opened[i] batches and leaves left[i] characters.  Without such an i it opens
# none and leaves c + total.
_FUNCTION = "reach array<bigint>, opened array<bigint>, left array<bigint>, total bigint"
_STATE = "chars_in bigint, opened_before bigint, total_batches bigint"


def record_chars(columns: Sequence[str], overhead: int = RECORD_OVERHEAD_CHARS) -> Column:
    """Characters of the projected values, NULL counting nothing, plus the overhead."""
    lengths = [F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in columns]
    return reduce(lambda a, b: a + b, lengths) + F.lit(overhead).cast("long")


def _starts(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Running total, and for a batch opened at each row the row opening the next."""
    running = np.cumsum(sizes)
    before = running - sizes
    following = np.searchsorted(running, before + budget, side="right")
    return running, np.maximum(following, np.arange(1, len(sizes) + 1))


def _enter(reach, opened, left, total: int, chars: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Apply a function to several entry states at once."""
    first = np.searchsorted(reach, budget - chars, side="right")
    breaks = first < len(reach)
    safe = np.where(breaks, first, 0)
    return np.where(breaks, opened[safe], 0), np.where(breaks, left[safe], chars + total)


def _block_function(sizes: np.ndarray, budget: int) -> tuple:
    running, following = _starts(sizes, budget)
    n = len(sizes)
    # pointer doubling: follow all chains of batch starts to the block's end
    hop = np.append(following, n)
    opened = np.append(np.ones(n, dtype=np.int64), 0)
    last = np.append(np.arange(n), n)
    while (hop < n).any():
        opened = opened + opened[hop]
        last = np.where(hop < n, last[hop], last)
        hop = hop[hop]
    left = running[-1] - (running - sizes)[last[:n]]
    # an open batch holds at least one character, so no later row can be first
    reachable = min(int(np.searchsorted(running, budget - 1, side="right")) + 1, n)
    return running[:reachable], opened[:reachable], left[:reachable], int(running[-1])


def _compose(functions: list[tuple], budget: int) -> tuple:
    """The function of consecutive blocks as one."""
    reach = np.empty(0, dtype=np.int64)
    opened, left = reach.copy(), reach.copy()
    total = 0
    for child_reach, child_opened, child_left, child_total in functions:
        more, left = _enter(child_reach, child_opened, child_left, child_total, left, budget)
        opened = opened + more
        if total <= budget - 1:
            reach = np.concatenate([reach, child_reach + total])
            opened = np.concatenate([opened, child_opened])
            left = np.concatenate([left, child_left])
        total += child_total
    keep = min(int(np.searchsorted(reach, budget - 1, side="right")) + 1, len(reach))
    return reach[:keep], opened[:keep], left[:keep], total


def _function(row) -> tuple:
    return tuple(np.asarray(v, dtype=np.int64) for v in (row.reach, row.opened, row.left)) + (int(row.total),)


def _walk(children: pd.DataFrame, chars: int, opened: int, budget: int) -> tuple[list, int, int]:
    """The state on entry to each child, and after the last."""
    states = []
    for row in children.itertuples(index=False):
        states.append((chars, opened))
        more, left = _enter(*_function(row), np.array([chars]), budget)
        chars, opened = int(left[0]), opened + int(more[0])
    return states, chars, opened


def pack_batches(
    df: DataFrame, id_column: str, order: str | Sequence[str], columns: Sequence[str], budget: int = BATCH_BUDGET_CHARS,
    overhead: int = RECORD_OVERHEAD_CHARS, block_rows: int = BLOCK_ROWS, fan_in: int = FAN_IN, size: str | None = None,
) -> DataFrame:
    """``(id, position, rec_chars, batch_index, total_batches)`` for every record.

    ``order`` is the integer source row number, which ``position`` then shows, or a list of columns
    giving a total order, such as source file and row.  Rows are numbered densely in that order, equal
    ones by id, so neither gaps nor repeats matter and a block holds ``block_rows`` rows.  A
    record over the budget sits alone.  ``size`` names a column that holds the sizes already.
    The sized rows are shuffled once; both passes read the same shuffle.
    """
    if overhead < 1:
        raise ValueError("the overhead bounds the work per block and must be at least 1")
    id_type = df.schema[id_column].dataType.simpleString()
    chars = (record_chars(columns, overhead) if size is None else F.col(size).cast("long")).alias("rec_chars")
    keys = [F.col(c).alias(f"order_{i}") for i, c in enumerate([order] if isinstance(order, str) else order)]
    bare = df.select(F.col(id_column).alias("id"), *keys, chars)
    numbered = number_rows(bare, [*(f"order_{i}" for i in range(len(keys))), "id"], "pos")
    shown = F.col("order_0").cast("long") if isinstance(order, str) else F.col("pos")
    sized = numbered.select(
        "id", "pos", shown.alias("position"), "rec_chars", F.floor((F.col("pos") - 1) / F.lit(block_rows)).cast("long").alias("block"))

    def summarise(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        block = int(rows["block"].iloc[0])
        return _function_row((block // fan_in, block), _block_function(rows["rec_chars"].to_numpy(np.int64), budget))

    def combine(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        whole = _compose([_function(r) for r in blocks.itertuples(index=False)], budget)
        return _function_row((int(blocks["tree"].iloc[0]),), whole, ["tree"])

    def enter_trees(trees: pd.DataFrame) -> pd.DataFrame:
        trees = trees.sort_values("tree")
        states, _, total = _walk(trees, budget, 0, budget)
        return pd.DataFrame({
            "tree": trees["tree"].to_numpy(),
            "chars_in": [s[0] for s in states], "opened_before": [s[1] for s in states], "total_batches": total,
        })

    def enter_blocks(blocks: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        entry = state.iloc[0]
        states, _, _ = _walk(blocks, int(entry.chars_in), int(entry.opened_before), budget)
        return pd.DataFrame({
            "block": blocks["block"].to_numpy(),
            "chars_in": [s[0] for s in states], "opened_before": [s[1] for s in states],
            "total_batches": int(entry.total_batches),
        })

    def assign(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        entry = state.iloc[0]
        running, following = _starts(rows["rec_chars"].to_numpy(np.int64), budget)
        opens = np.zeros(len(rows), dtype=np.int64)
        at = int(np.searchsorted(running, budget - int(entry.chars_in), side="right"))
        while at < len(rows):
            opens[at] = 1
            at = int(following[at])
        return pd.DataFrame({
            "id": rows["id"], "position": rows["position"], "rec_chars": rows["rec_chars"],
            "batch_index": int(entry.opened_before) + np.cumsum(opens), "total_batches": int(entry.total_batches),
        })

    blocks = sized.groupBy("block").applyInPandas(summarise, f"tree bigint, block bigint, {_FUNCTION}")
    # one tree stands for fan_in * block_rows source rows (268 million by default)
    trees = blocks.groupBy("tree").applyInPandas(combine, f"tree bigint, {_FUNCTION}")
    tree_states = trees.withColumn("root", F.lit(0)).groupBy("root").applyInPandas(enter_trees, f"tree bigint, {_STATE}")
    block_states = (
        blocks.groupBy("tree").cogroup(tree_states.groupBy("tree")).applyInPandas(enter_blocks, f"block bigint, {_STATE}")
    )
    packed = (
        sized.groupBy("block").cogroup(block_states.groupBy("block")).applyInPandas(
            assign, f"id {id_type}, position bigint, rec_chars bigint, batch_index bigint, total_batches bigint"
        )
    )
    return packed.select(F.col("id").alias(id_column), "position", "rec_chars", "batch_index", "total_batches")


def _function_row(keys: tuple, function: tuple, names: Sequence[str] = ("tree", "block")) -> pd.DataFrame:
    reach, opened, left, total = function
    return pd.DataFrame({
        **{name: [key] for name, key in zip(names, keys)},
        "reach": [reach], "opened": [opened], "left": [left], "total": [total],
    })


def batch_summary(packed: DataFrame, id_column: str, overhead: int = RECORD_OVERHEAD_CHARS, status: str = "pending") -> DataFrame:
    """One row per batch.  Its id list is bounded: at most ``budget / overhead`` records fit."""
    return packed.groupBy("batch_index").agg(
        F.max("total_batches").alias("total_batches"),
        F.count(F.lit(1)).alias("record_count"),
        F.sum(F.col("rec_chars") - F.lit(overhead)).alias("estimated_chars"),
        F.sort_array(F.collect_list(F.struct("position", F.col(id_column).cast("string").alias("id")))).alias("_ids"),
    ).select(
        F.format_string(BATCH_ID_FORMAT, "batch_index").alias("batch_id"),
        "batch_index", "total_batches", "record_count", "estimated_chars",
        F.lit(status).alias("status"),
        F.col("_ids.id").alias("record_ids"),
    )


def coverage(candidates: DataFrame, packed: DataFrame, statuses: DataFrame, id_column: str) -> DataFrame:
    """How much of the candidate set the reviewed batches cover.

    ``statuses`` has one row per batch: batch_index, status.  Evaluated and
    failed ids are counted as the batches list them, so an id in a completed
    and a failed batch counts in both; ``outside_candidates`` tells how many
    counted ids are no candidates.
    """
    done = packed.join(statuses.select("batch_index", "status"), "batch_index", "left")
    marks = candidates.select(
        F.col(id_column).alias("id"), F.lit(1).alias("c"), F.lit(0).alias("e"), F.lit(0).alias("f")
    ).unionByName(done.select(
        F.col(id_column).alias("id"), F.lit(0).alias("c"),
        F.coalesce((F.col("status") == "completed").cast("int"), F.lit(0)).alias("e"),
        F.coalesce((F.col("status") == "failed").cast("int"), F.lit(0)).alias("f"),
    ))
    c, e, f = F.col("c") == 1, F.col("e") == 1, F.col("f") == 1
    counts = marks.groupBy("id").agg(F.max("c").alias("c"), F.max("e").alias("e"), F.max("f").alias("f")).agg(
        F.count_if(c).alias("total_candidates"),
        F.count_if(e).alias("evaluated_count"),
        F.count_if(f).alias("failed_count"),
        F.count_if(c & ~e & ~f).alias("skipped_count"),
        F.count_if(~c & (e | f)).alias("outside_candidates"),
    )
    total, evaluated = F.col("total_candidates"), F.col("evaluated_count")
    return counts.withColumn(
        "coverage_percentage", F.when(total > 0, percentage(evaluated, total)).otherwise(F.lit(100.0))
    ).withColumn(
        "is_100_percent_covered",
        (total == evaluated) & (F.col("skipped_count") == 0) & (F.col("failed_count") == 0),
    )
