"""Bitmap sets, large limits, digest trees and bucketed tables against plain Python."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rollbook.operators import idsets, selection
from rollbook.operators.evidence import evidence_appendix
from rollbook.sources import digests, sinks


def _ids(spark, values, name="n", kind="long"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def test_sets_across_buckets(spark):
    draw = random.Random(5)
    a = {draw.randrange(1, 200_000) for _ in range(3000)} | {1, 32768, 32769}
    b = {draw.randrange(1, 100_000) for _ in range(3000)} | {1, 32769}
    left, right = idsets.id_set(_ids(spark, [*a, *list(a)[:50], None]), "n"), idsets.id_set(_ids(spark, b), "n")
    every = spark.range(1, 200_001).withColumnRenamed("id", "n")
    for operation, wanted in {"INTERSECT": a & b, "UNION": a | b, "EXCEPT": a - b}.items():
        both = idsets.combine_sets(left, right, operation)
        assert {r[0] for r in idsets.members(every, "n", both).collect()} == wanted
        assert idsets.set_size(both).first()[0] == len(wanted)
        trace = idsets.set_trace(left, right, operation).first()
        assert tuple(trace) == (len(a), len(b), operation, len(wanted))
        assert both.count() <= 200_000 // 32768 + 1
    assert {r[0] for r in idsets.members(every, "n", left, keep=False).collect()} == set(range(1, 200_001)) - a
    assert idsets.combine_sets(left, None) is left and idsets.combine_sets(None, right) is right
    with pytest.raises(ValueError):
        idsets.combine_sets(None, None)


def test_empty_sets(spark):
    none, some = idsets.id_set(_ids(spark, []), "n"), idsets.id_set(_ids(spark, [4]), "n")
    assert [r[0] for r in idsets.members(_ids(spark, [4, 5, None]), "n", idsets.except_sets(some, none)).collect()] == [4]
    assert idsets.intersect_sets(some, none).count() == 0
    assert tuple(idsets.set_trace(none, none).first()) == (0, 0, "INTERSECT", 0)
    assert tuple(idsets.set_coverage(none, none, none).first()) == (0, 0, 0, 0, 0, 100.0, True)
    assert tuple(idsets.set_coverage(some, some, none).first()) == (1, 1, 0, 0, 0, 100.0, True)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_large_limits(spark, kind, monkeypatch):
    monkeypatch.setattr(selection, "REPORT_IDS", 10)
    monkeypatch.setattr(selection, "CUT_RANGES", 16)
    draw = random.Random(7)
    ends = [-(2 ** 63), 2 ** 63 - 1, 0, -1, None]
    values = [*{*[draw.randrange(-500, 500) for _ in range(300)], *ends}]
    if kind == "string":
        values = [v if v is None else f"{v}" for v in values]
    ordered = sorted((v for v in values if v is not None))
    for n in (11, 100, len(values) - 1, len(values), len(values) + 50):
        limited = selection.limit_ids(_ids(spark, values, kind=kind), "n", n)
        assert sorted(r[0] for r in limited.filter("n IS NOT NULL").collect()) == ordered[:n - 1]
        assert limited.filter("n IS NULL").count() == 1
        if kind == "long":  # a filter; text ids sum up one count per partition
            assert "Exchange" not in limited._jdf.queryExecution().executedPlan().toString()
    assert selection.limit_ids(_ids(spark, [], kind=kind), "n", 20).count() == 0


def test_difference_of_builds(spark, tmp_path):
    before = [(i, f"text {i}") for i in range(2000)] + [(7, "again"), (None, "no id"), (9, None)]
    after = [(i, f"text {i}" if i != 40 else "other") for i in range(2000) if i != 50] + [(7, "again"), (7, "again"), (None, "no id"), (9, ""), (3000, "new")]
    schema = "id long, text string"
    a = digests.write_digested(spark.createDataFrame(before, schema), "id", ["text"], f"{tmp_path}/a", levels=2)
    b = digests.write_digested(spark.createDataFrame(after, schema).repartition(5), "id", ["text"], f"{tmp_path}/b", as_in=a)
    found = digests.difference(a, b, "id")
    assert rows(found, "id", "change") == sorted(
        [(7, "added"), (9, "altered"), (40, "altered"), (50, "missing"), (3000, "added")], key=lambda r: str(r[0]))
    read, total = found.select("n_blocks_read", "n_blocks").first()
    assert read <= 5 and total == 256
    assert digests.difference(a, digests.open_digested(spark, f"{tmp_path}/a"), "id").count() == 0
    with pytest.raises(ValueError):
        digests.differing_blocks(a, digests.write_digested(spark.createDataFrame(after, schema), "id", ["text"], f"{tmp_path}/c", levels=1))
    none = spark.createDataFrame([], schema)
    empty = digests.write_digested(none, "id", ["text"], f"{tmp_path}/d")
    assert empty.levels == 0 and digests.difference(empty, empty, "id").count() == 0


def test_many_differing_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(digests, "NAMED_BLOCKS", 3)
    table = spark.range(500).withColumn("text", F.lit("a"))
    a = digests.write_digested(table, "id", ["text"], f"{tmp_path}/a", levels=2)
    b = digests.write_digested(table.withColumn("text", F.when(F.col("id") % 7 == 0, "b").otherwise(F.col("text"))), "id", ["text"], f"{tmp_path}/b", as_in=a)
    assert {r["id"] for r in digests.difference(a, b, "id").collect()} == set(range(0, 500, 7))


def test_evidence_of_bucketed_tables_moves_no_texts(spark, tmp_path):
    table = spark.range(3000).select(F.col("id").cast("string").alias("record_id"), F.lit("f").alias("source_file"), F.col("id").alias("row_idx"),
                                     F.concat(F.lit("t"), "id").alias("body"))
    raw = sinks.write_bucketed(table.withColumnRenamed("body", "body_raw"), f"{tmp_path}/raw", "record_id", 4)
    normalised = sinks.write_bucketed(table, f"{tmp_path}/normalised", "record_id", 4)
    records = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("record_id"), F.lit(1).alias("n_findings"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = evidence_appendix(raw, normalised, records, {"body": True})
        plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
        deep = {i: len(line) - len(line.lstrip(" :+-*()0123456789")) for i, line in enumerate(plan)}
        for i, line in enumerate(plan):
            if "Exchange hashpartitioning" in line:
                below = []
                for j in range(i + 1, len(plan)):
                    if deep[j] <= deep[i]:
                        break
                    below.append(plan[j])
                assert not any("body" in b for b in below), "\n".join(plan)
        assert out.count() == 1000
        again = sinks.open_bucketed(spark, f"{tmp_path}/raw", "record_id", 4)
        joined = again.join(normalised, "record_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 3000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
