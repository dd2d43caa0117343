import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rollbook.operators import evidence as ev
from rollbook.operators import lessons as le
from rollbook.operators.numbering import number_rows
from rollbook.sources.register import parse_findings, read_findings

SCHEMA = ("finding_id string, finding_type string, claim string, supporting_records array<string>, counter_records array<string>, "
          "confidence string, confidence_reason string, hypotheses array<string>")


@pytest.fixture(scope="module")
def findings(spark):
    return spark.createDataFrame([
        ("F-01", "root_cause_pattern", "朝の便に集中している", ["REC-001", "REC-002"], ["REC-004"], "high", "", ["h1", "h2"]),
        ("F-02", "root_cause_pattern", "台帳にない番号を挙げる", ["REC-999"], [], "low", "", None),
        ("F-03", "anomaly", " \u3000\n", [], None, "medium", "", []),
        ("F-04", "anomaly", "many", ["x4", "x1", "x3", "x2", "REC-001"], ["y1", "REC-002"], "medium", "", ["only"]),
        ("F-05", "anomaly", "shared", ["REC-002", "REC-002"], ["REC-002"], "medium", "", None),
        ("F-06", "anomaly", "nothing named", [None, "REC-001"], None, "medium", "", None),
    ], SCHEMA)


@pytest.fixture(scope="module")
def validated(spark, findings):
    candidates = spark.createDataFrame([(f"REC-00{i}",) for i in range(1, 5)], "record_id string")
    headers = findings.drop("supporting_records", "counter_records")
    return ev.validate_findings(headers, ev.cited_records(findings), candidates).cache()


def test_reasons(validated):
    got = {r.finding_id: (r.accepted, r.reasons) for r in validated.collect()}
    assert got == {
        "F-01": (True, []),
        "F-02": (False, ["Supporting records not found in candidate set: ['REC-999'] (total missing: 1)"]),
        "F-03": (False, ["Finding claim is empty.", "Finding lacks supporting records."]),
        "F-04": (False, ["Supporting records not found in candidate set: ['x4', 'x1', 'x3'] (total missing: 4)",
                         "Counter records not found in candidate set: ['y1'] (total missing: 1)"]),
        "F-05": (True, []),
        "F-06": (False, ["Supporting records not found in candidate set: [None] (total missing: 1)"]),
    }
    assert rows(ev.finding_totals(validated)) == [(6, 2, 4)]


def test_findings_of_many_documents_stay_apart(spark):
    document = '[{"claim": "x", "supporting_records": ["REC-001"]}, {"finding_id": "FIND-001", "claim": "y", "supporting_records": ["%s"], "derived_batch_ids": ["batch-001"]}]'
    documents = spark.createDataFrame([(1, document % "gone"), (2, document % "REC-002")], "doc int, json string")
    parsed = parse_findings(documents, "json", keep=["doc"])
    headers, cited = parsed.drop("supporting_records", "counter_records"), ev.cited_records(parsed)
    candidates = spark.createDataFrame([("REC-001",), ("REC-002",)], "record_id string")
    validated = ev.validate_findings(headers, cited, candidates).cache()
    assert rows(validated, "finding_key", "finding_id", "n_supporting", "accepted") == [
        ("1/1", "FIND-001", 1, True), ("1/2", "FIND-001", 1, False), ("2/1", "FIND-001", 1, True), ("2/2", "FIND-001", 1, True)]
    kept = ev.accepted_citations(validated, cited)
    assert rows(ev.evidence_index(kept), "record_id", "finding_key") == [("REC-001", "1/1"), ("REC-001", "2/1"), ("REC-002", "2/2")]
    assert ev.insight_evidence(headers, kept).count() == 3 and ev.finding_summary(headers, kept).count() == 4
    assert rows(headers.filter("finding_key = '2/2'").select(F.array_join("derived_batch_ids", ","))) == [("batch-001",)]


def test_evidence_is_deduplicated(findings, validated):
    index = ev.evidence_index(ev.accepted_citations(validated, ev.cited_records(findings)))
    assert rows(index) == [
        ("REC-001", "F-01", True, False), ("REC-002", "F-01", True, False), ("REC-002", "F-05", True, True), ("REC-004", "F-01", False, True)]
    assert rows(ev.evidence_records(index)) == [("REC-001", 1), ("REC-002", 2), ("REC-004", 1)]


def test_summary(findings):
    headers, cited = findings.drop("supporting_records", "counter_records"), ev.cited_records(findings)
    got = {r.finding_id: r for r in ev.finding_summary(headers, cited, shown=3).collect()}
    assert (got["F-01"].n_supporting, got["F-01"].n_counter, got["F-01"].n_hypotheses, got["F-01"].has_more) == (2, 1, 2, False)
    assert (got["F-04"].first_supporting, got["F-04"].has_more) == ("x4, x1, x3", True)
    assert (got["F-03"].n_supporting, got["F-03"].first_supporting) == (0, "")
    assert rows(ev.finding_hypotheses(headers)) == [("F-01", 1, "h1"), ("F-01", 2, "h2"), ("F-04", 1, "only")]
    assert ("F-05", "REC-002") in rows(ev.counter_evidence(cited))


def test_long_map(findings):
    headers, cited = findings.drop("supporting_records", "counter_records"), ev.cited_records(findings)
    got = rows(ev.insight_evidence(headers, cited).filter("finding_id = 'F-01'"))
    assert [r[:4] for r in got] == [
        ("F-01", "root_cause_pattern", "counter", "REC-004"), ("F-01", "root_cause_pattern", "supporting", "REC-001"),
        ("F-01", "root_cause_pattern", "supporting", "REC-002")]


def test_appendix_keeps_null_and_empty_apart(spark):
    raw = spark.createDataFrame([("a", "f.csv", 2, "line1\nline2", "UT"), ("b", "f.csv", 3, "", None), ("c", "f.csv", 4, "z", "z")],
                                "record_id string, source_file string, row_idx long, cause_raw string, phase_raw string")
    done = spark.createDataFrame([("a", "p_ut", "単体試験"), ("b", None, None)], "record_id string, phase string, phase_label string")
    cited = spark.createDataFrame([("a", 2), ("b", 1)], "record_id string, n_findings long")
    assert rows(ev.evidence_appendix(raw, done, cited, {"cause": False, "phase": True})) == [
        ("a", "f.csv", 2, 2, "cause", "line1<br>line2", "-"), ("a", "f.csv", 2, 2, "phase", "UT", "単体試験"),
        ("b", "f.csv", 3, 1, "cause", "", "-"), ("b", "f.csv", 3, 1, "phase", "*NULL*", "*NULL*")]


@pytest.mark.parametrize("wrapped", [False, True])
def test_findings_file(spark, tmp_path, wrapped):
    items = [
        {"finding_id": "X-1", "type": "anomaly", "claim": "c", "supporting_records": ["a"], "confidence": "high"},
        {"finding_type": "escape_pattern", "confidence": "sure", "counter_records": ["b"], "hypotheses": ["h"]},
        {"claim": "only a claim", "confidence_reason": "seen"},
    ]
    path = tmp_path / "findings.json"
    path.write_text(json.dumps({"findings": items} if wrapped else items, indent=1), encoding="utf-8")
    got = rows(read_findings(spark, str(path)).select("finding_id", "finding_type", "claim", "confidence", "confidence_reason", "supporting_records", "hypotheses"))
    default = "Supported by deterministic candidate records"
    assert got == [
        ("FIND-002", "escape_pattern", "", "medium", default, None, ["h"]),
        ("FIND-003", "root_cause_pattern", "only a claim", "medium", "seen", None, None),
        ("X-1", "anomaly", "c", "high", default, ["a"], None)]


def test_a_broken_findings_file_is_an_error(spark, tmp_path):
    path = tmp_path / "broken.json"
    path.write_text('\n [{"finding_id": "a"', encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_findings(spark, str(path)).collect()


def test_listed_hypotheses_fill_gaps(spark, findings):
    listed = spark.createDataFrame([("F-01", ["no"]), ("F-02", ["yes"]), ("F-03", ["also"])], "finding_id string, hypotheses array<string>")
    got = dict(rows(ev.fill_hypotheses(findings, listed), "finding_id", "hypotheses"))
    assert got == {"F-01": ["h1", "h2"], "F-02": ["yes"], "F-03": ["also"], "F-04": ["only"], "F-05": None, "F-06": None}


def lessons(spark):
    return spark.createDataFrame([
        ("LES-1", "candidate", {}), ("LES-2", "accepted", {"analysis_type": "landscape"}), ("LES-3", "retired", {}),
        ("LES-4", "rejected", {}), ("LES-5", "odd", None), ("LES-6", "accepted", {"component": "x"}),
    ], "lesson_id string, status string, scope map<string,string>")


def test_lessons(spark):
    def names(**how):
        return [r[0] for r in rows(le.applicable_lessons(lessons(spark), **how), "lesson_id")]
    assert names() == ["LES-1", "LES-2", "LES-5", "LES-6"]
    assert names(only_accepted=True) == ["LES-2", "LES-6"]
    assert names(analysis_type="filtered") == ["LES-1", "LES-5", "LES-6"]
    assert names(analysis_type="landscape", only_accepted=True) == ["LES-2", "LES-6"]
    got = dict(rows(le.applicable_lessons(lessons(spark)), "lesson_id", "status"))
    assert got["LES-5"] == "candidate"


def test_feedback_numbers_on_from_the_ledger(spark):
    df = spark.createDataFrame([(t, f"r{t}", "analysis_feedback", f"text {t}", "lesson", {"a": "b"}) for t in (30, 10, 20)],
                               "at int, run_id string, lesson_type string, user_feedback string, derived_lesson string, scope map<string,string>")
    got = rows(le.record_feedback(df, ["at"], ledger_size=2), "lesson_id", "feedback_id", "run_id", "status")
    assert got == [(f"LES-000{i + 3}", f"FB-000{i + 3}", f"r{t}", "candidate") for i, t in enumerate((10, 20, 30))]


def test_numbering_with_a_hot_leading_key(spark):
    df = spark.range(10000).select(F.when(F.col("id") > 3000, "hot").otherwise("cold").alias("k"), (10000 - F.col("id")).alias("v"))
    got = number_rows(df.repartition(16), ["k", "v"], "n").collect()
    ordered = sorted(got, key=lambda r: (r.k, r.v))
    assert [r.n for r in ordered] == list(range(1, 10001))


def test_ledger(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    fields = "at int, run_id string, lesson_type string, user_feedback string, derived_lesson string, scope map<string,string>"

    def batch(*runs):
        return spark.createDataFrame([(i, r, "t", "f", "d", {"k": r}) for i, r in enumerate(runs)], fields)
    assert le.read_ledger(spark, path).count() == 0
    le.append_feedback(batch("a", "b"), ["at"], path, "one")
    le.append_feedback(batch("x", "y", "z"), ["at"], path, "one")  # ignored
    # an attempt that was never committed is not read
    le.record_feedback(batch("lost"), ["at"], 2).write.parquet(f"{path}/lessons/attempt=lost")
    # another writer takes the next number first
    commit, taken = le._commit, []

    def late(spark, path, number, content):
        if not taken:
            taken.append(number)
            le.append_feedback(batch("c"), ["at"], path, "two")
        return commit(spark, path, number, content)
    monkeypatch.setattr(le, "_commit", late)
    ledger = le.append_feedback(batch("d", "e"), ["at"], path, "three")
    le.append_feedback(batch(), ["at"], path, "empty")
    assert rows(ledger, "lesson_id", "run_id", "batch_key") == [
        ("LES-0001", "a", "one"), ("LES-0002", "b", "one"), ("LES-0003", "c", "two"), ("LES-0004", "d", "three"), ("LES-0005", "e", "three")]
    assert le.read_ledger(spark, path).count() == 5 and ledger.filter("scope['k'] = run_id").count() == 5
