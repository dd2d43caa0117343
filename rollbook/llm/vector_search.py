"""Exact top-k inner products by a vector-approximation file.

Every vector is kept twice: its integers, and a small approximation of one byte
per component, the component's high bits, with a shift of the vector's own.
The approximation fixes a cell, so an inner product with a query lies between
two bounds.  The scan reads only approximations, in blocks of vectors against
blocks of queries, and drops what cannot be among the best k.  Exact vectors
are then read in the order of their bounds: the k most promising first, whose
exact scores settle how far down the order one has to read.

In a cluster of nearly equal vectors cells tell nothing apart.  The integers therefore
travel with the cells, and a block reads those of a query's vectors when too many
are left, so that a query leaves a block with a bounded number of candidates.

Of equal vectors only the k + 1 smallest ids can ever be among the best k of
a query, so a large group of copies shrinks before the scan.

Cases: a vector that is NULL or holds a NULL, NaN or infinite component takes
no part, nor does a row without id; repeated rows count once; rows with the
query's id count as the query itself; only vectors of the same length are
compared; scores beyond the range of a long are taken in doubles and held at
its ends, and a crowded block keeps all such candidates; columns besides id, vector
and those of ``is_query`` are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollbook.session import materialise

SCALE = 1024
BLOCK_VECTORS = 65536
SMALL_BLOCK = 4096
BLOCK_QUERIES = 8192
STRIP = 64
CELL_BITS = 7
CROWD = 4


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """``(id, q)`` of the rows that take part, each once: ``q`` holds floor(scale * x)."""
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return (
        vectors.filter(F.col(id_column).isNotNull() & v.isNotNull() & finite)
        .select(F.col(id_column).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("q"))
        .dropDuplicates(["id", "q"])
    )


def _peak(q: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(q, lambda x: F.abs(x.cast("double")))), F.lit(0.0))


def _cells(vectors: DataFrame) -> DataFrame:
    """``(id, dim, shift, cells, exact)``: one signed byte per component, and the integers in two bytes each, or eight."""
    def approximate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            shifts, cells, exact = [], [], []
            for q in rows["q"]:
                q = np.asarray(q, dtype=np.int64)
                peak = int(max(q.max(initial=0), ~q.min(initial=0)))
                shift = max(0, peak.bit_length() - CELL_BITS)
                shifts.append(shift)
                cells.append((q >> shift).astype(np.int8).tobytes())
                exact.append(q.astype("<i2" if peak < 2**15 else "<i8").tobytes())
            yield pd.DataFrame({"id": rows["id"], "dim": rows["q"].map(len), "shift": shifts, "cells": cells, "exact": exact})
    return vectors.select("id", "q").mapInPandas(approximate, "id long, dim int, shift int, cells binary, exact binary")


def _whole(packed: pd.Series, dim: int) -> np.ndarray:
    """The exact integers of a block's vectors, one row each."""
    out = np.zeros((len(packed), dim), dtype=np.int64)
    for row, data in zip(out, packed):
        row[:] = np.frombuffer(data, "<i2" if len(data) == 2 * dim else "<i8")
    return out


def _scan(k: int):
    """Candidates of one block of queries in one block of cells.

    Where the cells leave a query more than ``CROWD`` * k vectors, the block's exact vectors decide: k are left.
    """
    def scan(cells: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query": [], "id": [], "low": [], "high": []}).astype({"query": "int64", "id": "int64"})]
        if len(cells) and len(queries):
            ids = cells["id"].to_numpy()
            dim = int(cells["dim"].iloc[0])
            corner = np.frombuffer(b"".join(cells["cells"]), dtype=np.int8).reshape(len(ids), dim).astype(np.float32).T
            unit = np.exp2(cells["shift"].to_numpy(dtype=np.float64))
            whole, most = None, 0.0
            for at in range(0, len(queries), STRIP):
                part = queries.iloc[at:at + STRIP]
                q = np.array(part["q"].tolist(), dtype=np.float64).reshape(len(part), dim)
                base = (q @ corner.astype(np.float64) if dim else np.zeros((len(part), len(ids)))) * unit
                up, down = np.maximum(q, 0).sum(1)[:, None], np.maximum(-q, 0).sum(1)[:, None]
                blur = 1e-12 * (up + down) * (unit * 128)  # rounding, where doubles are not exact
                low, high = base - down * (unit - 1) - blur, base + up * (unit - 1) + blur
                own = part["id"].to_numpy()[:, None] == ids
                low[own] = -np.inf
                floor = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k, None] if len(ids) > k else -np.inf
                open_ = (high >= floor) & ~own
                for r in np.flatnonzero(open_.sum(axis=1) > CROWD * k):
                    if whole is None:
                        whole = _whole(cells["exact"], dim)
                        most = np.abs(whole.astype(np.float64)).max(initial=0)
                    col = np.flatnonzero(open_[r])
                    bound = np.abs(q[r]).max(initial=0) * most * max(dim, 1)
                    if bound >= 2.0**62:  # beyond exact integers; the exact vectors are read later
                        continue
                    kind = np.float64 if bound < 2.0**53 else np.int64
                    score = whole[col].astype(kind) @ np.asarray(part["q"].iloc[r]).astype(kind)
                    best = np.lexsort((ids[col], -score))[:k]
                    open_[r] = False
                    open_[r, col[best]] = True
                    low[r, col[best]] = high[r, col[best]] = score[best]
                row, col = np.nonzero(open_)
                found.append(pd.DataFrame({
                    "query": part["query"].to_numpy()[row], "id": ids[col], "low": low[row, col], "high": high[row, col]}))
        return pd.concat(found, ignore_index=True)
    return scan


def _exact(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """The pairs (query, id, ...) with their score from the exact vectors."""
    q, v = F.col("q"), F.col("v")
    wide = F.aggregate(F.zip_with(q, v, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    held = F.when(wide >= 2.0**63, F.lit(2**63 - 1)).when(wide <= -(2.0**63), F.lit(-(2**63))).otherwise(F.floor(wide))
    whole = F.aggregate(F.zip_with(q, v, lambda a, b: a * b), F.lit(0).cast("long"), lambda a, x: a + x)
    safe = _peak(q) * _peak(v) * F.greatest(F.size(q), F.lit(1)) < 2.0**62
    return (
        pairs.join(vectors.select("id", F.col("q").alias("v")), "id")
        .join(queries.select("query", F.col("id").alias("query_id"), "q"), "query")
        .filter(F.size("q") == F.size("v"))
        .select("query", "query_id", "id", F.when(safe, whole).otherwise(held).alias("score"))
    )


def _kth(rows: DataFrame, value: str, k: int) -> DataFrame:
    """Per query the k-th largest value, where there are k."""
    place = F.row_number().over(W.partitionBy("query").orderBy(F.col(value).desc()))
    return rows.select("query", value, place.alias("place")).filter(F.col("place") <= k).filter(F.col("place") == k).select(
        "query", F.col(value).alias("bar"))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE,
) -> DataFrame:
    """``(query_id, rank, id, score)``: for the rows where ``is_query`` holds, the k highest scores over all other rows."""
    spark = vectors.sparkSession
    flagged = vectors.select(F.col(id_column).alias("_id"), F.col(vector_column).alias("_vector"), is_query.alias("_is_query"))
    queries = materialise(quantised(flagged.filter("_is_query"), "_id", "_vector", scale).select(
        F.xxhash64("id", "q").alias("query"), "id", "q"), "queries")
    copies = F.row_number().over(W.partitionBy("q").orderBy("id"))
    exact = materialise(
        quantised(flagged, "_id", "_vector", scale).withColumn("_copy", copies).filter(F.col("_copy") <= k + 1).drop("_copy"), "exact")
    approximate = materialise(_cells(exact), "cells")

    n, n_queries = approximate.count(), queries.count()
    blocks = max(1, math.ceil(n / BLOCK_VECTORS), min(math.ceil(n / SMALL_BLOCK), spark.sparkContext.defaultParallelism))
    parts = max(1, math.ceil(n_queries / BLOCK_QUERIES))
    left = approximate.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = queries.withColumn("dim", F.size("q")).withColumn("part", F.pmod(F.col("query"), F.lit(parts)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    key = ["dim", "block", "part"]
    candidates = materialise(
        left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_scan(k), "query long, id long, low double, high double"),
        "candidates")

    bars = _kth(candidates, "low", k)
    near = candidates.join(bars, "query", "left").filter(F.col("bar").isNull() | (F.col("high") >= F.col("bar"))).drop("bar")
    order = W.partitionBy("query").orderBy(F.col("high").desc(), "id")
    placed = materialise(near.withColumn("place", F.row_number().over(order)), "near")
    first = materialise(_exact(placed.filter(F.col("place") <= k), queries, exact), "first")
    settled = _kth(first, "score", k)
    later = placed.filter(F.col("place") > k).join(settled, "query", "left").filter(
        F.col("bar").isNull() | (F.col("high") >= F.col("bar")))
    scored = first.unionByName(_exact(later, queries, exact))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
