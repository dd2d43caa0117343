import math
import random

import pytest
from pyspark.sql import functions as F

from rollbook.llm import vector_search as vs


def brute(rows, k):
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            seen[i, tuple(math.floor(1024 * x) for x in v)] = None
    out = []
    for i, q in seen:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in seen if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, k=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in vs.top_k(df, F.col("vec_id") % 100 == 0, k).collect())


def test_equals_brute_force(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 0.2) for _ in range(16)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in centres[i % 6]]) for i in range(700)]
    assert run(spark, rows) == brute(rows, 10)


def test_awkward_vectors(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(300)]
    rows += [(300, None), (400, [1.0, None, 0.0, 0.0]), (500, [math.nan] * 4), (600, [math.inf, 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    rows += [(700, [0.5, 0.5]), (701, [0.25, -0.5]), (800, []), (801, []), (100, rows[100][1]), (950, [1e6, -1e6, 3.0, 0.0])]
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []


def test_many_copies_of_one_vector(spark):
    rows = [(i, [0.5, -0.25, 0.125]) for i in range(400)] + [(i, [0.4, -0.2, 0.001 * (i % 50)]) for i in range(400, 600)]
    assert run(spark, rows) == brute(rows, 10)


@pytest.mark.parametrize("scale", [1, 1 << 12, 1 << 20])
def test_a_cluster_of_nearly_equal_vectors(spark, scale):
    rng = random.Random(8)
    centre = [rng.uniform(-0.5, 0.5) for _ in range(12)]
    rows = [(i, [scale * (x + rng.uniform(-0.002, 0.002)) for x in centre]) for i in range(2_000)]
    assert run(spark, rows) == brute(rows, 10)
    exact = vs.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    cells = vs._cells(exact).toPandas()
    queries = exact.filter(F.col("id") % 100 == 0).select(F.col("id").alias("query"), "id", "q").toPandas()
    assert vs._scan(10)(cells, queries).groupby("query").size().max() <= vs.CROWD * 10


def test_huge_components_are_held(spark):
    got = run(spark, [(0, [1e300]), (1, [1e300]), (2, [-1e300])])
    assert [r[1:3] for r in got] == [(1, 1), (2, 2)] and got[0][3] == 2**63 - 1 and got[1][3] == -(2**63)


@pytest.mark.parametrize("k", [1, 3])
def test_fewer_wanted(spark, k):
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(250)]
    assert run(spark, rows, k) == brute(rows, k)
