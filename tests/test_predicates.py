import pytest
from conftest import rows
from pyspark.sql import functions as F

from rollbook.functions.predicates import all_of, condition
from rollbook.operators.normalization import canonical_literal, dictionary_mappings, named_items, ordinal_condition, ordinal_literal
from rollbook.fixed import PHASES


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame([(1, "a"), (2, "b%c"), (3, ""), (4, None), (5, "b_c"), (6, "xa")], "id int, v string")


@pytest.mark.parametrize("operator, value, ids", [
    ("eq", "a", [1]),
    ("neq", "a", [2, 3, 5, 6]),
    ("in", ["a", ""], [1, 3]),
    ("not_in", ["a", ""], [2, 5, 6]),
    ("lt", "b", [1, 3]),
    ("lte", "a", [1, 3]),
    ("gt", "b_c", [6]),
    ("gte", "b_c", [5, 6]),
    ("between", ["a", "b%c"], [1, 2]),
    ("is_null", None, [3, 4]),
    ("is_not_null", None, [1, 2, 5, 6]),
    ("contains", "%", [2]),
    ("contains", "_", [5]),
    ("starts_with", "b", [2, 5]),
    ("ends_with", "a", [1, 6]),
])
def test_operator(values, operator, value, ids):
    assert [r[0] for r in rows(values.filter(condition("v", operator, value)), "id")] == ids


def test_null_test_on_numbers(spark):
    df = spark.createDataFrame([(1, 0), (2, None)], "id int, n int")
    assert rows(df.filter(condition("n", "is_null", text=False)), "id") == [(2,)]
    assert rows(df.filter(condition("n", "is_not_null", text=False)), "id") == [(1,)]


def test_conjunction(values):
    assert rows(values.filter(all_of([])), "id") == [(i,) for i in range(1, 7)]
    both = all_of([condition("v", "starts_with", "b"), condition("id", "gt", 2)])
    assert rows(values.filter(both), "id") == [(5,)]


@pytest.mark.parametrize("operator, value, role", [
    ("gt", "高", "category"), ("in", [], "category"), ("in", "abc", "category"), ("between", [1], "numeric"),
    ("eq", " ", "status"), ("eq", None, "status"), ("eq", "x", "ignore"), ("like", "x", None), ("eq", "x", "long_text"),
])
def test_rejected(operator, value, role):
    with pytest.raises(ValueError):
        condition("v", operator, value, role)


def test_filters_reach_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "t")
    spark.range(10).select(F.col("id").alias("n"), F.lit("x").alias("v")).write.parquet(path)
    df = spark.read.parquet(path).filter(all_of([condition("n", "gte", 5), condition("v", "starts_with", "x")])).select("n")
    df.explain()
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(n,5)" in plan and "StringStartsWith(v,x)" in plan


def test_ordinal_literals():
    assert [ordinal_literal(v, PHASES) for v in (50, "50", "phase_integration", "結合試験", "it", "結合テスト")] == [50] * 6
    with pytest.raises(ValueError):
        ordinal_literal("nothing", PHASES)


def test_ordinal_comparison_is_by_position(spark):
    df = spark.createDataFrame([("phase_req", 10), ("phase_integration", 50), ("phase_operation", 80), (None, None)], "p string, p_ordinal int")
    assert rows(df.filter(ordinal_condition("p", "gte", "phase_integration", PHASES)), "p") == [("phase_integration",), ("phase_operation",)]
    assert rows(df.filter(ordinal_condition("p", "between", [40, "システム試験"], PHASES)), "p") == [("phase_integration",)]


def test_category_literals_mean_canonical_ids():
    assert canonical_literal("UT", PHASES) == "phase_unit_test"
    assert canonical_literal("phase_unit_test", PHASES) == "phase_unit_test"
    assert canonical_literal("高") == "val_高"
    assert canonical_literal("UI不備") == "val_ui不備"


def test_literals_through_a_dictionary_table(spark):
    """A list and a table with the same items give the same."""
    schema = "canonical_id string, label string, ordinal int, aliases array<string>"
    table = spark.createDataFrame([tuple(i) for i in PHASES], schema)
    for v in (50, "50", "phase_integration", "結合試験", "it", "結合テスト"):
        assert ordinal_literal(v, table) == ordinal_literal(v, PHASES) == 50
    with pytest.raises(ValueError):
        ordinal_literal("nothing", table)
    for v in ("UT", "phase_unit_test", "高", "UI不備"):
        assert canonical_literal(v, table) == canonical_literal(v, PHASES)
    shared = spark.createDataFrame([("b", "Two", 2, ["x"]), ("a", "One", 1, ["X"]), ("c", "None", None, None)], schema)
    assert named_items(shared, ["x", "two", "c", "zz"]) == {"x": ("a", "One", 1), "two": ("b", "Two", 2), "c": ("c", "None", None)}
    assert named_items(shared, []) == {}
    def mapped(dictionary):
        return {tuple(r) for r in dictionary_mappings(spark, "p", dictionary).collect()}
    assert mapped(table) == mapped(PHASES)
