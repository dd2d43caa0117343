import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollbook.operators import packing as pk


def sequential(sizes, budget):
    """Next-fit, one record after the other."""
    batches, current, used = [], 0, None
    for size in sizes:
        if used is None or used + size > budget:
            current, used = current + 1, size
        else:
            used += size
        batches.append(current)
    return batches, used


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 130), min_size=1, max_size=60), st.integers(1, 100), st.integers(1, 7), st.integers(1, 4))
def test_composed_functions_equal_the_sequential_walk(sizes, budget, block_rows, fan_in):
    blocks = [np.array(sizes[i:i + block_rows], dtype=np.int64) for i in range(0, len(sizes), block_rows)]
    functions = [pk._block_function(b, budget) for b in blocks]
    trees = [pk._compose(functions[i:i + fan_in], budget) for i in range(0, len(functions), fan_in)]
    want, left = sequential(sizes, budget)
    for level in (functions, trees):
        chars, opened = budget, 0
        for f in level:
            more, after = pk._enter(*f, np.array([chars]), budget)
            chars, opened = int(after[0]), opened + int(more[0])
        assert (opened, chars) == (want[-1], left)
        assert all(len(f[0]) <= budget + 1 for f in level)


def packed_frame(spark, lengths, gap=1, **options):
    df = spark.createDataFrame([(f"R{i:04d}", i * gap, "x" * n) for i, n in enumerate(lengths)], "record_id string, row_idx long, t string")
    return pk.pack_batches(df.repartition(5), "record_id", "row_idx", ["t"], **options)


@pytest.mark.parametrize("gap, block_rows, fan_in", [(1, 1 << 16, 1 << 12), (1, 7, 3), (13, 20, 2)])
def test_any_blocking_gives_the_same_batches(spark, gap, block_rows, fan_in):
    rng = np.random.default_rng(5)
    lengths = [int(n) for n in rng.integers(0, 300, 400)]
    lengths[10] = lengths[11] = lengths[399] = 2000
    got = packed_frame(spark, lengths, gap, budget=600, block_rows=block_rows, fan_in=fan_in).orderBy("position").collect()
    want, _ = sequential([n + 50 for n in lengths], 600)
    assert [r.batch_index for r in got] == want
    assert {r.total_batches for r in got} == {want[-1]}


def test_exact_fit_and_oversize(spark):
    got = packed_frame(spark, [50, 50, 51, 500, 0], budget=200).orderBy("position").collect()
    assert [r.batch_index for r in got] == [1, 1, 2, 3, 4]


def test_constant_sizes_over_many_blocks(spark):
    got = packed_frame(spark, [50] * 101, budget=300, block_rows=2, fan_in=4).orderBy("position").collect()
    assert [r.batch_index for r in got] == [i // 3 + 1 for i in range(101)]


def test_rows_of_many_files_pack_in_file_order(spark):
    data = [(f"{f}{i}", f, i, "x" * ((i * 37 + ord(f)) % 200)) for f in "abc" for i in range(2, 60)]
    df = spark.createDataFrame(data, "record_id string, source_file string, row_idx long, t string").repartition(7)
    got = pk.pack_batches(df, "record_id", ["source_file", "row_idx"], ["t"], budget=600, block_rows=16, fan_in=3).orderBy("position").collect()
    assert [r.record_id for r in got] == [r[0] for r in data] and [r.position for r in got] == list(range(1, len(data) + 1))
    assert [r.batch_index for r in got] == sequential([len(r[3]) + 50 for r in data], 600)[0]


def test_no_records(spark):
    packed = packed_frame(spark, [])
    assert packed.count() == 0
    assert pk.batch_summary(packed, "record_id").count() == 0


def test_sizes_count_characters_and_skip_null(spark):
    df = spark.createDataFrame([("a", "テスト𠮷", None, 12)], "id string, t string, u string, n int")
    assert df.select(pk.record_chars(["id", "t", "u", "n"])).first()[0] == 1 + 4 + 2 + 50


def test_summary(spark):
    summary = pk.batch_summary(packed_frame(spark, [50, 50, 51], budget=200), "record_id").orderBy("batch_index").collect()
    assert [(r.batch_id, r.total_batches, r.record_count, r.estimated_chars, r.status, r.record_ids) for r in summary] == [
        ("batch-001", 2, 2, 100, "pending", ["R0000", "R0001"]), ("batch-002", 2, 1, 51, "pending", ["R0002"]),
    ]


def test_coverage_follows_the_statuses(spark):
    packed = packed_frame(spark, [100] * 10, budget=500)
    candidates = packed.select("record_id")
    none = spark.createDataFrame([], "batch_index long, status string")
    r = pk.coverage(candidates, packed, none, "record_id").first()
    assert (r.coverage_percentage, r.skipped_count, r.is_100_percent_covered) == (0.0, 10, False)
    done = packed.select("batch_index").distinct().withColumn("status", F.lit("completed"))
    r = pk.coverage(candidates, packed, done, "record_id").first()
    assert (r.total_candidates, r.evaluated_count, r.coverage_percentage, r.is_100_percent_covered) == (10, 10, 100.0, True)
    partly = spark.createDataFrame([(1, "completed"), (2, "failed"), (3, "pending")], "batch_index long, status string")
    r = pk.coverage(candidates, packed, partly, "record_id").first()
    assert (r.evaluated_count, r.failed_count, r.skipped_count, r.coverage_percentage) == (3, 3, 4, 30.0)


def test_coverage_counts_as_the_batches_list(spark):
    candidates = spark.createDataFrame([("a",), ("b",)], "record_id string")
    packed = spark.createDataFrame([("a", 1), ("a", 2), ("x", 1)], "record_id string, batch_index long")
    statuses = spark.createDataFrame([(1, "completed"), (2, "failed")], "batch_index long, status string")
    assert rows(pk.coverage(candidates, packed, statuses, "record_id")) == [(2, 2, 1, 1, 1, 100.0, False)]
    empty = candidates.limit(0)
    r = pk.coverage(empty, packed.limit(0), statuses, "record_id").first()
    assert (r.total_candidates, r.coverage_percentage, r.is_100_percent_covered) == (0, 100.0, True)


def test_overhead_must_bound_the_work(spark):
    with pytest.raises(ValueError):
        packed_frame(spark, [1], overhead=0)


def test_sparse_and_repeated_numbers(spark):
    rng = np.random.default_rng(3)
    places = [int(p) for p in rng.integers(0, 2**62, 3000)]
    places[7] = places[8] = places[9]
    lengths = [int(n) for n in rng.integers(0, 300, 3000)]
    df = spark.createDataFrame([(f"R{i:04d}", p, "x" * n) for i, (p, n) in enumerate(zip(places, lengths))], "record_id string, row_idx long, t string")
    got = pk.pack_batches(df.repartition(5), "record_id", "row_idx", ["t"], budget=600, block_rows=256, fan_in=4).collect()
    got = sorted(got, key=lambda r: (r.position, r.record_id))
    order = sorted(range(3000), key=lambda i: (places[i], i))
    want, _ = sequential([lengths[i] + 50 for i in order], 600)
    assert [r.record_id for r in got] == [f"R{i:04d}" for i in order] and [r.batch_index for r in got] == want
