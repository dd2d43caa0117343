import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rollbook.operators import gram_index as gi
from rollbook.operators import joins
from rollbook.operators import lexical as lx
from rollbook.operators import reduction
from rollbook.operators import selection as sel


@pytest.fixture(scope="module")
def register(spark):
    return spark.createDataFrame([
        ("REC-01", "印刷キューの滞留", "用紙切れの見落とし"),
        ("REC-02", "一覧の並び違い", "NIL値の混入"),
        ("REC-03", "夜間転送の遅れ", "回線再接続の待ち"),
        ("REC-04", None, "100%_done"),
        ("REC-05", "ab", ""),
    ], "record_id string, title string, cause string")


def found(df):
    return [r[0] for r in rows(df, "record_id")]


def test_scan(register):
    assert found(lx.scan_search(register, "record_id", ["title", "cause"], ["再接続"])) == ["REC-03"]
    assert found(lx.scan_search(register, "record_id", ["title"], ["印刷キュー"])) == ["REC-01"]
    assert found(lx.scan_search(register, "record_id", ["title"], ["再接続"])) == []
    assert found(lx.scan_search(register, "record_id", ["title", "cause"], ["nil", "用紙"])) == ["REC-01", "REC-02"]
    assert found(lx.scan_search(register, "record_id", ["cause"], ["0%_D"])) == ["REC-04"]
    assert found(lx.scan_search(register, "record_id", ["cause"], ["%e"])) == []


@pytest.mark.parametrize("indexed", [False, True])
def test_text_and_term_are_folded_alike(spark, tmp_path, indexed):
    texts = {"a": "ＡＢＣＤ　項目", "b": "two  spaces here", "c": "line one \r\n line two", "d": "ｶﾀｶﾅ", "e": None}
    df = spark.createDataFrame(list(texts.items()), "record_id string, t string")
    index = gi.write_index(df, "record_id", ["t"], str(tmp_path / "index"))

    def ids(term):
        if indexed:
            return found(gi.index_search(df, index, "record_id", ["t"], [term]))
        return found(lx.scan_search(df, "record_id", ["t"], [term]))
    for key, text in texts.items():
        if text:
            assert ids(text) == [key]
    assert ids("abcd 項目") == ["a"] and ids("Two Spaces") == ["b"] and ids("one\nline") == ["c"] and ids("カタカナ") == ["d"]


def test_blank_terms_are_refused(register):
    for terms in ([], ["a", " "]):
        with pytest.raises(ValueError):
            lx.scan_search(register, "record_id", ["title"], terms)


def test_expanded_terms(register):
    got = rows(lx.expanded_search(register, "record_id", ["title", "cause"], ["再接続"], ["転送", "用紙"]))
    assert got == [("REC-01", False, True), ("REC-03", True, True)]
    assert rows(lx.expanded_search(register, "record_id", ["cause"], ["用紙"], [])) == [("REC-01", True, False)]


def test_postings(spark, register, tmp_path):
    index = gi.write_index(register, "record_id", ["title", "cause"], str(tmp_path / "index"))
    held = {}
    for p in index.postings.collect():
        places = p.places if p.bits is None else [i for i in range(8 * len(p.bits)) if p.bits[i // 8] >> i % 8 & 1]
        names = {r.place: r.record_id for r in index.rows.filter(f"segment = {p.segment}").collect()}
        assert len(places) == p.n_records
        for place in places:
            held.setdefault((p.column_id, names[place]), set()).add(p.gram)
    assert held["cause", "REC-05"] == held["title", "REC-05"] == {""}
    assert held["cause", "REC-04"] == {"", "100", "00%", "0%_", "%_d", "_do", "don", "one"}
    assert found(gi.indexed_ids(index, "record_id")) == ["REC-01", "REC-02", "REC-03", "REC-04", "REC-05"]
    counts = {(r.column_id, r.gram): r.n_records for r in gi.gram_frequencies(index).collect()}
    assert counts["cause", ""] == 5 and counts["cause", "100"] == 1


def test_many_terms_are_one_pattern(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc. \n(é𠮷") for _ in range(40)) for _ in range(150)]
    terms = ["a(b", "abca", "ab", "é𠮷", "b.c", "..", "𠮷𠮷𠮷", "c\na", "zz", "ccc", "a b", "(("] + ["ba" + c * 3 for c in "abcé"]
    df = spark.createDataFrame(list(enumerate(texts)), "record_id int, t string")
    for clean in (True, False):
        plain = [set(found(lx.scan_search(df, "record_id", ["t"], [t], clean))) for t in terms]
        assert set(found(lx.scan_search(df, "record_id", ["t"], terms, clean))) == set.union(*plain) != set(range(150))
        few = lx.expanded_search(df, "record_id", ["t"], ["zz", "(("], terms)
        assert {r.record_id for r in few.filter("hit_primary").collect()} == set(found(lx.scan_search(df, "record_id", ["t"], ["zz", "(("])))


@pytest.mark.parametrize("rows_max,bytes_max", [(200_000, 64 << 20), (0, 64 << 20), (0, 0)])
def test_reduced_semi_join(spark, monkeypatch, rows_max, bytes_max):
    monkeypatch.setattr(joins, "BROADCAST_ROWS_MAX", rows_max)
    monkeypatch.setattr(reduction, "BROADCAST_BYTES_MAX", bytes_max)
    wide = spark.range(5000).select(F.col("id").alias("record_id"), F.lit("text").alias("t")).unionByName(
        spark.createDataFrame([(None, "x"), (7, "again")], "record_id long, t string"))
    some = spark.createDataFrame([(i,) for i in (7, 7, 4999, 12345, None)], "record_id long")
    got = reduction.reduced_semi_join(wide, some, "record_id")
    assert rows(got) == [(4999, "text"), (7, "again"), (7, "text")] and got.columns == wide.columns
    if not rows_max and bytes_max:
        likely = reduction.likely_rows(wide, reduction.id_filter(some.dropna(), "record_id", 3), "record_id", 1)
        assert 3 <= likely.count() < 60
    assert reduction.reduced_semi_join(wide, some.limit(0), "record_id").count() == 0


def test_filters_grow_with_the_ids():
    assert [reduction.filter_buckets(n) for n in (0, 1, 512, 513, 10_000_000)] == [1, 1, 1, 2, 19532]


@pytest.mark.parametrize("segment", [1 << 15, 30])
def test_index_finds_what_the_scan_finds(spark, tmp_path, monkeypatch, segment):
    rng = random.Random(7)
    letters = "abAB あ\n𠮷"
    data = [(f"R{i:03d}", *["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(2)]) for i in range(200)]
    df = spark.createDataFrame(data, "record_id string, title string, cause string")
    path = str(tmp_path / "index")
    monkeypatch.setattr(gi, "SEGMENT_ROWS", segment)
    index = gi.write_index(df.repartition(3), "record_id", ["title", "cause"], path)
    assert index.rows.count() == 200 and {r.record_id for r in index.rows.collect()} == {r[0] for r in data}
    for columns, terms in [(["title"], ["aba"]), (["title", "cause"], ["abab", "あ𠮷a"]), (["cause"], ["ab", "𠮷"]), (["cause"], ["bbあ", "a"]),
                           (["title", "cause"], ["zzz"]), (["title"], ["aaaaa", "bA"])]:
        want = [r[0] for r in data if any(t.lower() in r[1 + ["title", "cause"].index(c)].lower() for c in columns for t in terms)]
        got = found(gi.index_search(df, index, "record_id", columns, terms))
        assert got == want == found(lx.scan_search(df, "record_id", columns, terms))


def test_a_segment_leaves_in_small_batches(spark, tmp_path, monkeypatch):
    """Every posting of a segment comes out, so many at a time and not all at once."""
    monkeypatch.setattr(gi, "BATCH_POSTINGS", 50, raising=False)
    monkeypatch.setattr(gi, "PART_BYTES", 500, raising=False)
    sizes, whole = [], gi._batch
    monkeypatch.setattr(gi, "_batch", lambda schema, values: sizes.append(len(values["segment"])) or whole(schema, values))
    segment = gi._Segment(["title"])
    for i in range(20):
        segment.add(i, ["".join(chr(0x4E00 + 60 * i + k) for k in range(62)) + " same"])
    schema = gi.pa.schema([("column_id", gi.pa.string()), ("gram", gi.pa.string()), ("segment", gi.pa.int64()), ("n_records", gi.pa.int64()),
                           ("bits", gi.pa.binary()), ("places", gi.pa.list_(gi.pa.int16())), ("place", gi.pa.int32()), ("id", gi.pa.int64())])
    out = gi.pa.Table.from_batches(segment.drain(7, schema)).to_pylist()
    got = {r["gram"]: r for r in out if r["gram"] is not None}
    assert len(got) == 1 + 20 * 60 + 20 * 2 + 3 and got["same"[:3]]["n_records"] == 20 and got[""]["n_records"] == 20
    assert got["".join(chr(0x4E00 + 60 * 3 + k) for k in range(3))]["places"] == [3]
    assert sorted(r["id"] for r in out if r["id"] is not None) == list(range(20))
    assert max(sizes) <= 50


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "record_id int")


def test_set_algebra(spark):
    a, b = ids(spark, 1, 2, 3), ids(spark, 2, 3, 4)
    assert found(sel.combine_ids(a, b)) == [2, 3]
    assert found(sel.combine_ids(a, b, "UNION")) == [1, 2, 3, 4]
    assert found(sel.combine_ids(a, b, "EXCEPT")) == [1]
    assert found(sel.combine_ids(a, b, "SQL_ONLY")) == found(sel.combine_ids(a, None)) == [1, 2, 3]
    assert found(sel.combine_ids(a, b, "FTS_ONLY")) == found(sel.combine_ids(None, b)) == [2, 3, 4]
    with pytest.raises(ValueError):
        sel.combine_ids(None, None)


def test_trace(spark):
    assert rows(sel.retrieval_trace(ids(spark, 1, 2, 3), ids(spark, 2, 3, 4, 5), "record_id")) == [(3, 4, "INTERSECT", 2)]
    assert rows(sel.retrieval_trace(ids(spark, 1, 2, 3), ids(spark, 2, 3, 4, 5), "record_id", "UNION")) == [(3, 4, "UNION", 5)]
    assert rows(sel.retrieval_trace(ids(spark), ids(spark), "record_id")) == [(0, 0, "INTERSECT", 0)]


def test_fetching(spark, register):
    wanted = spark.createDataFrame([("REC-03",), ("REC-01",), ("REC-03",)], "record_id string")
    got = sel.fetch_records(register, wanted, "record_id", ["cause", "record_id", "cause"], order="title")
    assert got.columns == ["record_id", "cause"]
    assert [r[0] for r in got.collect()] == ["REC-01", "REC-03"]
    assert sel.restrict(register, wanted, "record_id").columns == register.columns
    assert found(sel.limit_ids(register.select("record_id"), "record_id", 2)) == ["REC-01", "REC-02"]


def test_semantic_filter(spark):
    judged = spark.createDataFrame([(1, "MATCH", "x"), (2, "NO_MATCH", "y"), (9, "MATCH", "z"), (4, "maybe", "?")], "record_id int, judgment string, reason string")
    assert rows(sel.semantic_filter(ids(spark, 1, 2, 3), judged, "record_id")) == [(1, "MATCH", "x")]
    kept = sel.semantic_filter(ids(spark, 1, 2, 3), judged, "record_id", keep_uncertain=True)
    assert rows(kept) == [(1, "MATCH", "x"), (3, "UNCERTAIN", None)]
    assert rows(sel.semantic_filter(ids(spark, 4), judged, "record_id", keep_uncertain=True)) == [(4, "UNCERTAIN", "?")]
