from conftest import rows

from rollbook.operators import quality as q
from rollbook.operators import statistics as st


def frame(spark, data, schema="severity string, severity_label string, detect_phase string, day string"):
    return spark.createDataFrame(data, schema)


def test_distribution_uses_label_then_value_then_marker(spark):
    df = frame(spark, [("a", "A", "p", None), ("a", "A", "p", None), ("b", None, None, None)])
    got = rows(st.distributions(df, ["severity", "detect_phase"]))
    assert got == [
        ("detect_phase", "(NULL)", 1, 33.33), ("detect_phase", "p", 2, 66.67), ("severity", "A", 2, 66.67), ("severity", "b", 1, 33.33),
    ]


def test_a_date_without_label_is_a_dimension_too(spark):
    df = frame(spark, [("a", "A", "p", "2025-01-01")])
    assert rows(st.distribution(df, "day")) == [("2025-01-01", 1, 100.0)]


def test_no_candidates(spark):
    df = frame(spark, [])
    assert rows(st.distributions(df, ["severity", "day"])) == []
    assert rows(st.cross_tabs(df, [("severity", "day")])) == []
    assert rows(st.monthly_trend(df, ["day"])) == []


def test_no_dimensions(spark):
    df = frame(spark, [("a", "A", "p", "2025-01-01")])
    assert st.distributions(df, []).columns == ["dimension", "category", "count", "percentage"]
    for empty in (st.distributions(df, []), st.monthly_trend(df, []), st.cross_tabs(df, []), q.audit_columns(df, [])):
        assert rows(empty) == []


def test_cross_tabs(spark):
    df = frame(spark, [("a", "A", "p", None), ("a", "A", "q", None), ("a", "A", "p", None)])
    assert st.default_pairs(df) == [("severity", "detect_phase")]
    assert rows(st.cross_tabs(df)) == [("severity_x_detect_phase", "A", "p", 2), ("severity_x_detect_phase", "A", "q", 1)]
    assert rows(st.cross_tabs(df.select("day"))) == []
    assert rows(st.cross_tab(df, "severity", "day")) == [("A", "(NULL)", 3)]


def test_trend_skips_missing_dates(spark):
    df = frame(spark, [(None, None, None, d) for d in ("2025-01-15", "2025-01-20", "2025-02-01", "", None)])
    assert rows(st.monthly_trend(df, ["day"])) == [("day", "2025-01", 2), ("day", "2025-02", 1)]


def test_top_categories_and_the_rest(spark):
    counts = spark.createDataFrame([("d", c, n) for c, n in zip("abcdefghij", [5, 9, 9, 1, 1, 1, 2, 3, 4, 1])] + [("e", "x", 1)],
                                   "dimension string, category string, count long")
    got = rows(st.top_categories(counts, 3), "dimension", "rank", "category", "count", "more_categories")
    assert got == [("d", 1, "b", 9, 0), ("d", 2, "c", 9, 0), ("d", 3, "a", 5, 0), ("d", 4, "...", 13, 7), ("e", 1, "x", 1, 0)]


def test_top_cells_break_ties_by_name(spark):
    cells = spark.createDataFrame([("p", r, c, 1) for r in "ba" for c in "yx"], "pair string, row_value string, column_value string, count long")
    assert rows(st.top_cross_cells(cells, 2), "row_value", "column_value", "rank") == [("a", "x", 1), ("a", "y", 2)]


def test_landscape(spark):
    df = spark.createDataFrame([("p", "t"), ("p", "u"), (None, "t")], "injection_phase string, defect_type string")
    assert rows(st.landscape(df)) == [
        ("defect_type", "t", 2, 66.67), ("defect_type", "u", 1, 33.33), ("injection_phase", "(NULL)", 1, 33.33), ("injection_phase", "p", 2, 66.67),
    ]
    assert rows(st.landscape(df.withColumnRenamed("defect_type", "x").withColumnRenamed("injection_phase", "detect_phase")).select("dimension").distinct()) == [("detect_phase",)]


def test_audit_columns(spark):
    long = "x" * 40
    df = spark.createDataFrame([("a", long), ("", long), (None, long + "y"), ("bbb", None), ("bbb", "")], "s string, t string")
    got = {r["column_id"]: r for r in q.audit_columns(df, ["s", "t"], ["t", "s"]).collect()}
    s, t = got["s"], got["t"]
    assert (s.total_records, s.null_count, s.null_percentage, s.distinct_count) == (5, 2, 40.0, 3)
    assert (s.min_len, s.max_len, s.avg_len) == (1, 3, 2.3)
    assert (t.null_count, t.distinct_count, t.min_len, t.max_len, t.avg_len) == (2, 3, 40, 41, 40.3)


def test_audit_of_nothing_but_blanks(spark):
    df = spark.createDataFrame([(None,), ("",)], "s string")
    r = q.audit_columns(df, ["s"], ["s"]).first()
    assert (r.null_count, r.null_percentage, r.distinct_count, r.min_len, r.max_len, r.avg_len) == (2, 100.0, 1, 0, 0, 0.0)


def test_audit_summary(spark):
    df = spark.createDataFrame([("x", "x", "周知する"), ("", "", "修正"), ("y", None, None)], "cause string, escape_cause string, countermeasure string")
    tests = {"same": q.identical_fields("cause", "escape_cause"), "weak": q.superficial("countermeasure")}
    got = {(s, m): v for s, m, v in q.audit_summary(df, ["cause"], ["cause"], tests).collect()}
    assert got["same", "count"] == 1 and got["weak", "count"] == 1
    assert got["cause", "total_records"] == 3 and got["cause", "null_count"] == 1 and got["cause", "distinct_count"] == 3
    assert rows(q.count_rows(df, **tests)) == [(3, 1, 1)]
