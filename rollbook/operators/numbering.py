"""Global row numbers without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollbook.session import materialise

_POSITION_MASK = (1 << 33) - 1


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str, start: int = 1) -> DataFrame:
    """Number rows ``start, start+1, ...`` in the given total order.

    Rows are range-partitioned and written with their place in the partition;
    only one count per partition is then summed up and broadcast, so the bound
    on that side is the number of shuffle partitions.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = materialise(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)))
    )
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + F.col("_place") + F.lit(start)).cast("long"))
        .drop("_part", "_place", "_rows", "_before")
    )
