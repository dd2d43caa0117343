"""A register of our own, built and analysed, against a plain walk over its rows."""

import csv

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rollbook.fixed import PHASES
from rollbook.operators import gram_index
from rollbook.plans import analysis, build
from rollbook.sources import register as rg

HEADERS = ["管理番号", "タイトル", "検出工程", "混入工程", "重要度", "不具合分類", "原因", "流出原因", "対策", "検出日", "状態"]
PHASE_WORDS = ["UT", "結合テスト", "ＳＴ", "単体", "IT", "総合", "本番"]
ORDINAL = {"UT": 40, "単体": 40, "結合テスト": 50, "IT": 50, "ＳＴ": 60, "総合": 60, "本番": 80}
LABEL = {40: "単体試験", 50: "結合試験", 60: "システム試験", 80: "運用・保守"}
CAUSES = ["タイマー満了の競合", "ｳｫｯﾁﾄﾞｯｸﾞの停止漏れ", "NULL参照, 初期化漏れ", "排他制御の不足", "境界値の誤り"]


def golden():
    """Seventy rows made by rule."""
    out = []
    for i in range(70):
        cause = CAUSES[i % 5]
        out.append([
            f"BUG-{i:04d}", f"件名{i} {'タイマー異常' if i % 11 == 0 else '画面の不具合'}", PHASE_WORDS[i % 7], ["DD", "実装", "基本設計"][i % 3],
            ["高", "中", "低"][i % 3], ["UI不備", "境界値"][i % 2], f"{cause} その{i}", f"{cause} その{i}" if i % 10 == 0 else f"観点漏れ{i}",
            "関係者に周知する" if i % 9 == 0 else f"処理を修正{i}", f"2025-{i % 4 + 1:02d}-{i % 28 + 1:02d}", ["完了", "対応中"][i % 2],
        ])
    return out


@pytest.fixture(scope="module")
def register(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("register")
    source = folder / "golden.csv"
    with open(source, "w", encoding="utf-8", newline="") as f:
        csv.writer(f).writerows([HEADERS, *golden()])
    raw = rg.read_register(spark, str(source), id_header="管理番号")
    proposal = build.propose(raw, str(folder / "proposal"), "defect_id")
    assert proposal.review_queue.filter("column_id = 'detect_phase'").count() == 0
    return build.finalise(raw, proposal, str(folder / "register"), accept_pending=True, index=True)


@pytest.fixture(scope="module")
def result(register):
    return analysis.analyse(
        register, [("detect_phase", "gte", "結合試験")], analysis.Search(["タイマー"], ["ウォッチドッグ"]),
        projection=["title", "cause", "escape_cause", "countermeasure", "detect_phase"], budget=700,
    )


def test_published_files(spark, register, tmp_path_factory):
    exports = next((tmp_path_factory.getbasetemp()).glob("register*/register/exports"))
    def back(name):
        return spark.read.options(**rg.CSV_OPTIONS).option("header", True).csv(str(exports / name))
    assert back("normalized-data").count() == 70
    assert set(rows(back("column-catalog"), "column_id", "role")) == set(register.roles.items())
    assert back("normalize-map").columns == [
        "column_id", "raw_value", "canonical_id", "canonical_label", "ordinal", "status", "confidence", "source", "reason"]
    assert rows(back("normalize-map").select("status").distinct()) == [("accepted",)]
    assert back("validation-results").count() == 2


def searched(r):
    return any(t in r[1] + r[6].replace("ｳｫｯﾁﾄﾞｯｸﾞ", "ウォッチドッグ") for t in ("タイマー", "ウォッチドッグ"))


def expected():
    return [r for r in golden() if ORDINAL[r[2]] >= 50 and searched(r)]


def test_build(register):
    assert register.roles == {
        "defect_id": "record_id", "title": "short_text", "detect_phase": "ordered_category", "injection_phase": "ordered_category",
        "severity": "category", "defect_type": "category", "cause": "long_text", "escape_cause": "long_text",
        "countermeasure": "long_text", "detect_date": "date", "status": "status"}
    assert rows(register.findings) == [
        ("INFO", "fts", "FTS index verified: 70 records cleanly indexed."), ("INFO", "structure", "Total records verified: 70, total columns: 11")]
    got = rows(register.normalised, "record_id", "detect_phase_label", "detect_phase_ordinal", "severity", "row_idx")
    assert got == [(r[0], LABEL[ORDINAL[r[2]]], ORDINAL[r[2]], f"val_{r[4]}", i + 2) for i, r in enumerate(golden())]


def test_raw_text_is_verbatim_and_normalised_text_is_not_rewritten(register):
    raw = dict(rows(register.raw, "record_id", "cause_raw"))
    assert raw == {r[0]: r[6] for r in golden()}
    done = dict(rows(register.normalised, "record_id", "cause"))
    assert done["BUG-0000"] == raw["BUG-0000"] and done["BUG-0001"] == "ウォッチドッグの停止漏れ その1"


def test_candidates(result):
    want = expected()
    assert 5 < len(want) < 40
    assert [r[0] for r in rows(result.candidates)] == [r[0] for r in want]
    data = golden()
    assert rows(result.trace) == [
        (sum(ORDINAL[r[2]] >= 50 for r in data), sum(map(searched, data)), "INTERSECT", len(want), result.batches.count())]


def test_index_agrees(register):
    got = gram_index.index_search(register.normalised, register.index, "record_id", ["title", "cause"], ["タイマー", "ウォッチドッグ"])
    assert [r[0] for r in rows(got)] == [r[0] for r in golden() if searched(r)]


def test_an_indexed_search_gives_the_same(register):
    def ids(**how):
        return rows(analysis.analyse(register, [], analysis.Search(["タイマー"], ["ウォッチドッグ"], **how)).candidates)
    assert ids(indexed=True) == ids() and len(ids()) > 5


def test_search_columns_are_checked(register):
    answer = analysis.analyse(register, [], analysis.Search(["タイマー"], columns=["cause", "nowhere", "severity"]))
    assert [r[0] for r in rows(answer.candidates)] == [r[0] for r in golden() if "タイマー" in r[6]]
    assert len(answer.notes) == 2 and "nowhere" in answer.notes[0] and "severity" in answer.notes[1]
    assert analysis.analyse(register, [], analysis.Search(["タイマー"], columns=["nowhere"])).candidates.count() == 0


def test_only_the_first_pass_reads_texts(result):
    for frame in (result.distributions, result.cross_tabs, result.trends, result.packed, result.batches, result.candidates):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "escape_cause" not in plan and "title" not in plan


def test_judgments_drop_candidates(spark, register, tmp_path):
    judged = spark.createDataFrame(
        [(r[0], ("MATCH", "NO_MATCH", "maybe")[i % 3], "seen") for i, r in enumerate(golden()[:30])], "record_id string, judgment string, reason string")
    search = analysis.Search(["タイマー"])
    hit = {r[0] for r in golden() if "タイマー" in r[1] + r[6]}
    sure = {r[0] for i, r in enumerate(golden()[:30]) if i % 3 == 0}
    answer = analysis.analyse(register, [], search, judgments=judged)
    assert {r[0] for r in rows(answer.candidates)} == hit & sure
    assert rows(answer.trace, "final_candidate_count") == [(len(hit),)]
    lenient = analysis.analyse(register, [], search, judgments=judged, keep_uncertain=True)
    assert {r[0] for r in rows(lenient.candidates)} == hit - {r[0] for i, r in enumerate(golden()[:30]) if i % 3 == 1}
    headers, cited = analysis.split_findings(spark.createDataFrame(
        [], "finding_id string, finding_type string, claim string, supporting_records array<string>, counter_records array<string>, "
            "confidence string, confidence_reason string, hypotheses array<string>"))
    statuses = spark.createDataFrame([], "batch_index long, status string")
    analysis.complete(register, answer, headers, cited, statuses, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "semantic-judgments")).count() == 30
    assert spark.read.options(**rg.CSV_OPTIONS).option("header", True).csv(str(tmp_path / "filtered-records")).count() == len(hit & sure)


@pytest.mark.parametrize("state", ["pending", "accepted", "edited"])
def test_category_literals_follow_the_stored_map(spark, tmp_path, state):
    raw = spark.createDataFrame(
        [(f"R{i:02d}", "f", i, ["高", "低", "ＭＩＤ"][i % 3] if i % 10 else None) for i in range(60)],
        "record_id string, source_file string, row_idx long, severity_raw string")
    proposal = build.propose(raw, str(tmp_path / "p"))
    if state == "edited":
        proposal.mappings = proposal.mappings.withColumn(
            "canonical_id", F.when(F.col("raw_value") == "高", "sev_high").otherwise(F.col("canonical_id"))).withColumn(
            "canonical_label", F.when(F.col("raw_value") == "高", "High").otherwise(F.col("canonical_label"))).withColumn(
            "status", F.when(F.col("raw_value") == "高", "accepted").otherwise(F.col("status")))
    register = build.finalise(raw, proposal, str(tmp_path / "r"), accept_pending=state == "accepted", exports=False)
    value = {f"R{i:02d}": ["高", "低", "MID"][i % 3] for i in range(60) if i % 10}

    def ids(operator, literal):
        return {r[0] for r in rows(register.normalised.filter(analysis.filter_column(register, "severity", operator, literal)), "record_id")}
    high, low, mid = ({k for k, v in value.items() if v == name} for name in ("高", "低", "MID"))
    assert high and ids("eq", "高") == high and ids("neq", "高") == low | mid
    assert ids("in", ["高", "MID"]) == high | mid and ids("not_in", ["低", "高"]) == mid
    assert ids("eq", "nowhere") == set() and ids("neq", "nowhere") == set(value)
    if state == "edited":
        assert ids("eq", "sev_high") == high and ids("eq", "high") == high and ids("eq", "低") == low


def test_statistics(result):
    want = expected()
    phases = {label: n for d, label, n, _ in rows(result.distributions) if d == "detect_phase"}
    assert phases == {LABEL[o]: sum(ORDINAL[r[2]] == o for r in want) for o in {ORDINAL[r[2]] for r in want}}
    assert sum(n for d, _, n, _ in rows(result.distributions) if d == "detect_date") == len(want)
    assert {p for p, *_ in rows(result.cross_tabs)} == {"detect_phase_x_defect_type", "injection_phase_x_detect_phase", "severity_x_detect_phase"}
    assert rows(result.trends, "year_month", "count") == sorted(
        (m, sum(r[9].startswith(m) for r in want)) for m in {r[9][:7] for r in want})


def test_other_operations_and_limit(register):
    data = golden()
    search = analysis.Search(["タイマー"])
    hit = [r for r in data if "タイマー" in r[1] + r[6]]
    high = [r for r in data if r[4] == "高"]
    def ids(**how):
        return [r[0] for r in rows(analysis.analyse(register, [("severity", "eq", "高")], **how).candidates)]
    assert ids(search=search, operation="UNION") == sorted({r[0] for r in hit + high})
    assert ids(search=search, operation="EXCEPT") == sorted({r[0] for r in high} - {r[0] for r in hit})
    assert ids() == [r[0] for r in high]
    assert ids(search=search, limit=3) == sorted({r[0] for r in hit} & {r[0] for r in high})[:3]
    with pytest.raises(ValueError):
        analysis.filter_column(register, "severity", "gt", "高")
    with pytest.raises(ValueError):
        analysis.filter_column(register, "cause", "contains", "x")


def test_completion(spark, register, result, tmp_path):
    first = [r[0] for r in expected()]
    findings = spark.createDataFrame([
        ("FIND-001", "root_cause_pattern", "競合", first[:3], [first[3]], "high", "", ["共通化する"]),
        ("FIND-002", "root_cause_pattern", "対象外", ["BUG-9999"], [], "low", "", []),
    ], "finding_id string, finding_type string, claim string, supporting_records array<string>, counter_records array<string>, "
       "confidence string, confidence_reason string, hypotheses array<string>")
    split = analysis.split_findings(findings)
    assert result.batches.count() > 1
    done = result.batches.select("batch_index", F.lit("completed").alias("status"))
    out = analysis.complete(register, result, *split, done, str(tmp_path / "out"))
    assert out["coverage"].first().is_100_percent_covered
    partly = done.withColumn("status", F.when(F.col("batch_index") == 1, "failed").otherwise("completed"))
    assert not analysis.complete(register, result, *split, partly, str(tmp_path / "out2"))["coverage"].first().is_100_percent_covered
    assert rows(out["totals"]) == [(2, 1, 1)]
    assert rows(out["evidence_index"], "record_id", "finding_id") == [(i, "FIND-001") for i in first[:4]]
    appendix = out["appendix"]
    assert appendix.count() == 4 * len(HEADERS)
    by_id = {r[0]: r for r in golden()}
    shown = {r.record_id: (r.raw_value, r.normalized_value) for r in appendix.filter("column_id = 'detect_phase'").collect()}
    assert shown == {i: (by_id[i][2], LABEL[ORDINAL[by_id[i][2]]]) for i in first[:4]}
    written = spark.read.options(**rg.CSV_OPTIONS).option("header", True).csv(str(tmp_path / "out" / "filtered-records"))
    assert rows(written, "record_id") == [(i,) for i in first]
    assert written.columns == register.normalised.columns


def test_audit_and_landscape(register):
    got = {(s, m): v for s, m, v in analysis.audit(register).collect()}
    data = golden()
    assert got["identical_cause_and_escape_cause_count", "count"] == sum(r[6] == r[7] for r in data)
    assert got["superficial_countermeasure_keywords_count", "count"] == sum("周知" in r[8] for r in data)
    assert got["title", "distinct_count"] == 70 and got["detect_phase", "distinct_count"] == len(set(ORDINAL.values()))
    land = {(d, c): n for d, c, n, _ in analysis.landscape(register).collect()}
    assert land["defect_type", "UI不備"] == 35 and land["detect_phase", "運用・保守"] == 10


def test_phases_are_ordered():
    assert [p[2] for p in PHASES] == [10, 20, 30, 35, 40, 50, 60, 70, 80]
