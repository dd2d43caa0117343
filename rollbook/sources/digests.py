"""Stored tables with a tree of digests: two builds are compared top down, and only blocks that differ are read again.

Rows are dealt into blocks by a hash of their id and stored in block order, so that a filter on blocks skips the rest
of the files.  The digest of a block covers its rows, whatever their order; each level above covers sixteen blocks
of the level below, up to one digest of the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators.reduction import reduced_semi_join
from rollbook.session import materialise
from rollbook.sources.register import row_digest

FAN_OUT = 16
# Rows of a block where the number of levels is chosen from the table.
BLOCK_ROWS = 4096
# So many differing blocks are named in a pushed-down filter; more meet the rows in a join.
NAMED_BLOCKS = 2000
_DIGEST, _BLOCK = "_digest", "_block"


@dataclass(frozen=True)
class DigestedTable:
    """``table`` with its ``_block`` and row ``_digest``, and ``digests`` (level, block, n_rows, sha256); level 0 is the root."""

    table: DataFrame
    digests: DataFrame
    levels: int


def block_of(id_column: str, levels: int) -> Column:
    """The block of a row by its id; rows without id share one."""
    code = F.conv(F.substring(F.md5(F.col(id_column).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.coalesce(code % FAN_OUT ** levels, F.lit(0).cast("long"))


def levels_for(rows: int) -> int:
    """Levels below the root for so many rows."""
    levels = 0
    while FAN_OUT ** levels * BLOCK_ROWS < rows:
        levels += 1
    return levels


def _joined(*parts: str) -> Column:
    return F.concat_ws(":", *[F.col(p).cast("string") for p in parts])


def write_digested(
    df: DataFrame, id_column: str, columns: Sequence[str], path: str, levels: int | None = None, as_in: DigestedTable | None = None,
) -> DigestedTable:
    """Store the id and columns of a table with its digests under ``path``.

    A build that is to be compared with an earlier one takes its levels (``as_in``).  Repeated rows count, and
    NULL differs from the empty string.  Wide rows are shuffled once, into block order; a hot id puts its
    repeats into one block, which range partitions cannot split, so ids should be nearly unique.
    """
    spark = df.sparkSession
    if as_in is not None:
        levels = as_in.levels
    elif levels is None:
        levels = levels_for(df.count())
    wanted = [id_column, *[c for c in dict.fromkeys(columns) if c != id_column]]
    rows = df.select(*wanted, row_digest(wanted).alias(_DIGEST), block_of(id_column, levels).alias(_BLOCK))
    rows.repartitionByRange(_BLOCK, id_column).sortWithinPartitions(_BLOCK, id_column).write.mode("overwrite").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    sums = [F.sum(F.conv(F.substring(_DIGEST, at, 12), 16, 10).cast("decimal(38,0)")).cast("string") for at in (1, 13, 25, 37, 49)]
    level = stored.groupBy(F.col(_BLOCK).alias("block")).agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws(":", *sums).alias("sums"))
    level = level.select("block", "n_rows", F.sha2(_joined("block", "n_rows", "sums"), 256).alias("sha256"))
    for depth in range(levels, -1, -1):
        place = f"{path}/digests/level={depth}"
        level.write.mode("overwrite").parquet(place)
        # at most sixteen digests make one of the level above
        level = spark.read.parquet(place).groupBy(F.floor(F.col("block") / FAN_OUT).alias("block")).agg(
            F.sum("n_rows").alias("n_rows"), F.sort_array(F.collect_list(F.struct("block", "sha256"))).alias("of"),
        ).select("block", "n_rows", F.sha2(F.to_json("of"), 256).alias("sha256"))
    return open_digested(spark, path)


def open_digested(spark: SparkSession, path: str) -> DigestedTable:
    digests = spark.read.option("basePath", f"{path}/digests").parquet(f"{path}/digests")
    return DigestedTable(spark.read.parquet(f"{path}/rows"), digests, digests.agg(F.max("level")).first()[0] or 0)


def differing_blocks(a: DigestedTable, b: DigestedTable) -> DataFrame:
    """``(block)``: the blocks whose rows differ, found from the root down; of each level only what lies below a difference is compared."""
    if a.levels != b.levels:
        raise ValueError("the two builds have another number of levels; write one as in the other")
    suspects = None
    for depth in range(a.levels + 1):
        sides = []
        for build, name in ((a, "a"), (b, "b")):
            level = build.digests.filter(F.col("level") == depth).select("block", F.col("sha256").alias(name))
            if suspects is not None:
                level = level.withColumn("parent", F.floor(F.col("block") / FAN_OUT)).join(
                    suspects.withColumnRenamed("block", "parent"), "parent", "left_semi").select("block", name)
            sides.append(level)
        both = sides[0].join(sides[1], "block", "full")
        suspects = materialise(both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("block"), "blocks")
    return suspects


def difference(a: DigestedTable, b: DigestedTable, id_column: str) -> DataFrame:
    """``(id, change, n_blocks_read, n_blocks)``: the ids whose rows differ between two builds.

    ``change`` is altered, missing (from the second) or added.  Ids and row digests are read from differing blocks
    alone, no other column.  Repeats of an id are compared with their number; the NULL id is one of the ids.
    """
    blocks = differing_blocks(a, b)
    n_read = blocks.count()
    named = [r[0] for r in blocks.collect()] if n_read <= NAMED_BLOCKS else None

    def rows(build: DigestedTable, sign: int) -> DataFrame:
        if named is not None:
            read = build.table.filter(F.col(_BLOCK).isin(named))
        else:
            read = reduced_semi_join(build.table.select(id_column, _DIGEST, _BLOCK), blocks.withColumnRenamed("block", _BLOCK), _BLOCK)
        return read.select(id_column, _DIGEST, F.lit(sign).alias("_side"))

    tally = rows(a, -1).unionByName(rows(b, 1)).groupBy(id_column, _DIGEST).agg(F.sum("_side").alias("_left")).filter("_left <> 0")
    changes = tally.groupBy(id_column).agg(F.min("_left").alias("_gone"), F.max("_left").alias("_come"))
    change = F.when(F.col("_gone") > 0, "added").when(F.col("_come") < 0, "missing").otherwise("altered")
    return changes.select(
        id_column, change.alias("change"), F.lit(n_read).cast("long").alias("n_blocks_read"),
        F.lit(FAN_OUT ** a.levels).cast("long").alias("n_blocks"))
