import pytest
from conftest import rows
from pyspark.sql import functions as F

from rollbook.fixed import PHASES
from rollbook.operators import joins
from rollbook.operators import normalization as nz
from rollbook.operators import profiling as pf
from rollbook.operators.validation import is_valid, validate_build
from rollbook.sources.register import column_id


def test_dictionary(spark):
    df = spark.createDataFrame([("UT",), ("結合テスト",), ("ｕｔ",), (" unit  test ",), ("なし",), (None,)], "v string")
    got = {r.v: (r.canonical_id, r.canonical_label, r.ordinal) for r in nz.resolve(df, "v", PHASES).collect()}
    assert got["UT"] == got["ｕｔ"] == got[" unit  test "] == ("phase_unit_test", "単体試験", 40)
    assert got["結合テスト"] == ("phase_integration", "結合試験", 50)
    assert got["なし"] == got[None] == (None, None, None)


@pytest.fixture(scope="module")
def mappings(spark):
    values = ["UT"] * 50 + ["単体"] * 30 + ["結合試験"] * 20 + ["新フェーズ未定義"] * 5 + [None, ""]
    df = spark.createDataFrame([(v, "UI不備" if i else None) for i, v in enumerate(values)], "detect_phase string, defect_type string")
    counts = nz.value_counts(df, ["detect_phase", "defect_type"])
    return nz.propose_mappings(counts, {"detect_phase": PHASES}).cache()


def test_proposals(mappings):
    got = {r.raw_value: r for r in mappings.collect()}
    ut = got["UT"]
    assert (ut.canonical_id, ut.canonical_label, ut.ordinal, ut.confidence, ut.source, ut.status, ut.n_records) == (
        "phase_unit_test", "単体試験", 40, "high", "dictionary_match", "accepted", 50)
    assert ut.reason == "Matched known dictionary alias for '単体試験'"
    ui = got["UI不備"]
    assert (ui.canonical_id, ui.canonical_label, ui.ordinal, ui.confidence, ui.source, ui.status, ui.n_records) == (
        "val_ui不備", "UI不備", None, "low", "unknown_value", "pending", 106)
    assert set(got) == {"UT", "単体", "結合試験", "新フェーズ未定義", "UI不備"}


def big_dictionary(spark, n=6000):
    ids = spark.range(n)
    return ids.select(F.concat(F.lit("id_"), "id").alias("canonical_id"), F.concat(F.lit("Name "), "id").alias("label"),
                      F.col("id").cast("int").alias("ordinal"), F.array(F.concat(F.lit("Ｎ"), F.col("id").cast("string"))).alias("aliases"))


@pytest.mark.parametrize("as_table", [False, True])
def test_dictionaries_of_any_size(spark, as_table):
    table = big_dictionary(spark)
    names = table if as_table else [(r.canonical_id, r.label, r.ordinal, r.aliases) for r in table.collect()]
    df = spark.createDataFrame([("name 5999",), ("n17",), ("nothing",), ("NAME  3",)], "v string")
    got = {r.v: r.canonical_id for r in nz.resolve(df, "v", names).collect()}
    assert got == {"name 5999": "id_5999", "n17": "id_17", "nothing": None, "NAME  3": "id_3"}
    counts = nz.value_counts(df, ["v"])
    assert rows(nz.propose_mappings(counts, {"v": names}).filter("status = 'accepted'"), "canonical_id") == [("id_17",), ("id_3",), ("id_5999",)]
    near = spark.createDataFrame([("Name 59999",), ("zzzzzzzzz",)], "v string")
    assert rows(nz.similar_values(near, "v", names, 0.8), "v", "similar_name", "canonical_id", "similarity") == [
        ("Name 59999", "name 5999", "id_5999", 0.9)]


def test_values_are_scored_once(spark):
    df = spark.createDataFrame([("bolt",)] * 50, "v string")
    counts = nz.value_counts(df, ["v"]).drop("column_id")
    plan = nz.similar_values(counts, "raw_value", [("b", "bolts", 1, [])])._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" in plan and plan.count("count(1)") == 0


@pytest.mark.parametrize("large", [False, True])
def test_repeated_map_rows_are_refused(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr(joins, "BROADCAST_ROWS_MAX", 0)
    df = spark.createDataFrame([("1", "a")], "record_id string, c string")
    fields = "column_id string, raw_value string, canonical_id string, canonical_label string, ordinal int, status string"
    twice = spark.createDataFrame([("c", "a", "x", "X", 1, "accepted"), ("c", "a", "y", "Y", 2, "accepted")], fields)
    with pytest.raises(ValueError, match="c"):
        nz.apply_mappings(df, ["c"], twice, "record_id")
    once = twice.filter("canonical_id = 'x'").unionByName(twice.filter("canonical_id = 'y'").withColumn("status", F.lit("pending")))
    assert rows(nz.apply_mappings(df, ["c"], once, "record_id")) == [("1", "x", "X", 1)]


def test_several_large_columns_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS_MAX", 0)
    df = spark.createDataFrame([("1", "a", "p"), ("1", "b", "p"), ("2", None, "q"), ("2", None, "q")], "record_id string, c string, d string")
    fields = "column_id string, raw_value string, canonical_id string, canonical_label string, ordinal int, status string"
    maps = spark.createDataFrame([("c", "a", "x", "X", 1, "accepted"), ("d", "p", "y", "Y", None, "accepted")], fields)
    assert rows(nz.apply_mappings(df, ["c", "d"], maps, "record_id"), "record_id", "c", "d", "c_label", "d_label", "c_ordinal") == [
        ("1", "b", "y", "b", "Y", None), ("1", "x", "y", "X", "Y", 1), ("2", None, "q", None, "q", None), ("2", None, "q", None, "q", None)]


def test_review_queue(mappings):
    assert rows(nz.review_queue(mappings)) == [("defect_type", "UI不備", 106), ("detect_phase", "新フェーズ未定義", 5)]


@pytest.mark.parametrize("spread", [False, True])
def test_apply(spark, mappings, monkeypatch, spread):
    if spread:
        monkeypatch.setattr(joins, "BROADCAST_ROWS_MAX", 0)
    df = spark.createDataFrame([("1", "UT"), ("2", None), ("3", "新フェーズ未定義"), ("4", "見たことない")], "record_id string, detect_phase string")
    applied = nz.apply_mappings(df, ["detect_phase"], mappings, "record_id")
    assert rows(applied, "record_id", "detect_phase", "detect_phase_label", "detect_phase_ordinal") == [
        ("1", "phase_unit_test", "単体試験", 40), ("2", None, None, None),
        ("3", "新フェーズ未定義", "新フェーズ未定義", None), ("4", "見たことない", "見たことない", None),
    ]
    accepted = nz.apply_mappings(df, ["detect_phase"], nz.accept_pending(mappings), "record_id")
    assert rows(accepted.filter("record_id = '3'"), "detect_phase", "detect_phase_label") == [("val_新フェーズ未定義", "新フェーズ未定義")]


def test_spread_join_keeps_every_row(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") < 4000, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("4500", 2)], "k string, v int")
    joined = joins.spread_join(left, right, ["k"], ["id"])
    assert joined.count() == 5000 and joined.filter("v = 1").count() == 4000 and joined.filter("v = 2").count() == 1
    assert joins.spread_join(left, right, ["k"], ["id"], "left_semi").count() == 4001


def test_similar_values(spark):
    df = spark.createDataFrame([("結合試",), ("Unit Tests",), ("まったく別のもの",), (None,)], "v string")
    got = {r.v: (r.similar_name, r.canonical_id, r.similarity) for r in nz.similar_values(df, "v", PHASES, 0.6).collect()}
    assert got == {"結合試": ("結合試験", "phase_integration", 0.75), "Unit Tests": ("unit test", "phase_unit_test", 0.9)}
    with pytest.raises(ValueError):
        nz.similar_values(df, "v", [])


def test_raw_preserved(spark):
    raw = spark.createDataFrame([("1", "plain"), ("2", "ﾃｽﾄ"), ("3", "lost"), ("4", None)], "record_id string, cause_raw string")
    done = spark.createDataFrame([("1", "plain"), ("2", "テスト"), ("3", "other"), ("4", None)], "record_id string, cause string")
    assert rows(nz.raw_preserved(raw, done, "record_id", ["cause"])) == [("cause", 4, 3, 2)]


def test_header_ids():
    assert [column_id(h) for h in ("不具合番号", "検出工程", "原因", "123_custom", "My Column")] == [
        "defect_id", "detect_phase", "cause", "col_123_custom", "My_Column"]


def test_roles(spark):
    df = spark.createDataFrame([("DEF-001", "UT", "タイマー満了", "10"), ("DEF-002", "結合試験", "排他制御不足", "20"), ("DEF-003", "UT", "NULLポインタ", "30")],
                               "defect_id string, detect_phase string, cause string, count string")
    roles = pf.infer_roles(pf.profile_columns(df, df.columns))
    assert dict(rows(roles, "column_id", "role")) == {
        "defect_id": "record_id", "detect_phase": "ordered_category", "cause": "long_text", "count": "numeric"}
    catalog = {r.column_id: r for r in pf.catalog(roles).collect()}
    assert len(catalog) == 4 and catalog["detect_phase"].ordered and not catalog["cause"].filterable and catalog["cause"].searchable


def test_profile_of_blank_and_mixed_columns(spark):
    df = spark.createDataFrame([("2025-01-01", None), ("2025-01-02", ""), ("x", None), ("2025-01-01", None)], "d string, e string")
    got = {r.column_id: r for r in pf.profile_columns(df, ["d", "e"]).collect()}
    assert (got["d"].date_ratio, got["d"].distinct_count, got["d"].distinct_ratio, got["d"].null_count) == (0.75, 3, 0.75, 0)
    assert (got["e"].null_ratio, got["e"].distinct_count, got["e"].avg_len, got["e"].number_ratio) == (1.0, 0, 0.0, 0.0)


def test_long_values_are_tested_whole(spark):
    long_number, long_date = "1" * 45, "2025-01-01 " + "x" * 45
    df = spark.createDataFrame([(long_number, long_date), (long_number, "2025-01-01"), ("1" * 31, "x" * 45), ("x" * 32, None)], "n string, d string")
    got = {r.column_id: r for r in pf.profile_columns(df, ["n", "d"]).collect()}
    assert got["n"].number_ratio == 0.75 and got["d"].date_ratio == 2 / 3


def test_role_order(spark):
    profile = "column_id string, n_records long, null_count long, null_ratio double, distinct_count long, distinct_ratio double, min_len int, max_len int, avg_len double, date_ratio double, number_ratio double"
    df = spark.createDataFrame([
        ("assignee", 50, 0, 0.0, 50, 1.0, 2, 3, 2.0, 0.0, 0.0), ("when", 50, 0, 0.0, 50, 1.0, 10, 10, 10.0, 0.98, 0.0),
        ("status", 50, 0, 0.0, 1, 0.02, 2, 2, 2.0, 0.0, 0.0), ("body", 500, 0, 0.0, 500, 1.0, 90, 900, 300.0, 0.0, 0.0),
        ("note", 500, 0, 0.0, 500, 1.0, 5, 30, 12.0, 0.0, 0.0), ("bug_no", 50, 0, 0.0, 50, 1.0, 8, 8, 8.0, 0.0, 0.0),
    ], profile)
    assert dict(rows(pf.infer_roles(df, "bug_no"), "column_id", "role")) == {
        "assignee": "category", "when": "date", "status": "status", "body": "long_text", "note": "short_text", "bug_no": "record_id"}


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "record_id string")


def test_validation_messages(spark):
    good = ids(spark, ["a", "b"])
    assert rows(validate_build(good, good, good, "record_id", 3)) == [
        ("INFO", "fts", "FTS index verified: 2 records cleanly indexed."), ("INFO", "structure", "Total records verified: 2, total columns: 3")]
    assert rows(is_valid(validate_build(good, good, good, "record_id", 3))) == [(0, 0, 2, True)]


def test_validation_errors(spark):
    found = validate_build(ids(spark, ["a", "b", "c"]), ids(spark, ["a", "a", None, "d"]), ids(spark, ["a", "b"]), "record_id", 1)
    messages = [m for _, _, m in rows(found.filter("severity = 'ERROR'"))]
    assert sorted(messages) == [
        "1 ids occur more than once.", "1 records have no id.", "Index holds 2 records, register holds 4.",
        "Raw table holds 3 records, normalised table 4.",
    ]
    assert rows(is_valid(found), "is_valid") == [(False,)]


def test_validation_warns_about_unmapped_values(spark):
    df = spark.createDataFrame([("a", "p", 10), ("b", "q", None), ("c", None, None)], "record_id string, ph string, ph_ordinal int")
    found = validate_build(df, df, df, "record_id", 1, ["ph"])
    assert rows(found.filter("severity = 'WARNING'"), "message") == [("1 records hold unmapped values in ph.",)]
