import hashlib

import pytest
from conftest import rows

from rollbook.operators import joins
from rollbook.sources import register as rg
from rollbook.sources import sinks


def write(path, text):
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def test_values_stay_verbatim_and_rows_are_numbered(spark, tmp_path):
    path = write(tmp_path / "r.csv", '管理番号,原因\r\nD-1," a, ""b"" "\r\nD-2,"two\nlines"\r\nD-3,\r\nD-4,  spaced \r\n')
    raw = rg.read_register(spark, path, id_header="管理番号")
    assert raw.columns == ["record_id", "source_file", "row_idx", "defect_id_raw", "cause_raw"]
    assert rows(raw) == [
        ("D-1", "r.csv", 2, "D-1", ' a, "b" '), ("D-2", "r.csv", 3, "D-2", "two\nlines"), ("D-3", "r.csv", 4, "D-3", None),
        ("D-4", "r.csv", 5, "D-4", "  spaced ")]


def test_many_files_and_a_later_header_row(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for name in "ab":
        write(folder / f"{name}.csv", "made by hand,x\nid,text\n" + "".join(f"{name}{i},t{i}\n" for i in range(50)))
    raw = rg.read_register(spark, str(folder), ["id", "text"], header_row=2, id_header="id")
    got = rows(raw, "source_file", "row_idx", "record_id")
    assert sorted(got) == sorted((f"{n}.csv", i + 3, f"{n}{i}") for n in "ab" for i in range(50))
    with pytest.raises(ValueError):
        rg.read_register(spark, str(folder), header_row=2)


def test_files_with_other_column_orders(spark, tmp_path):
    folder = tmp_path / "orders"
    folder.mkdir()
    write(folder / "one.csv", "id,a,b\n1,x1,y1\n2,x2,\n")
    write(folder / "two.csv", "b,id,a\ny3,3,x3\n")
    raw = rg.read_register(spark, str(folder), ["id", "a", "b"], id_header="id")
    want = [("1", "one.csv", 2, "1", "x1", "y1"), ("2", "one.csv", 3, "2", "x2", None), ("3", "two.csv", 2, "3", "x3", "y3")]
    assert rows(raw) == want
    assert {(r[3], r[4]) for r in rows(rg.read_register(spark, str(folder), id_header="id").select("record_id", "source_file", "row_idx", "id_raw", "a_raw", "b_raw"))} == {
        ("1", "x1"), ("2", "x2"), ("3", "x3")}
    write(folder / "three.csv", "id,a,c\n4,x4,z4\n")
    with pytest.raises(ValueError):
        rg.read_register(spark, str(folder), ["id", "a", "b"], id_header="id")


def test_table_fingerprint(spark):
    data = [(i, f"t{i % 7}", None if i % 5 else "") for i in range(100)]

    def digest(rows_, n=4):
        return rg.table_fingerprint(spark.createDataFrame(rows_, "a int, b string, c string").repartition(n), ["a", "b", "c"]).first()
    whole = digest(data)
    assert whole.n_rows == 100 and whole == digest(data[::-1], 3)
    assert len({digest(d).sha256 for d in (data, data[1:], [*data, data[0]], [(-1, "t1", None), *data[1:]], [])}) == 5


def test_made_ids_are_stable(spark, tmp_path):
    path = write(tmp_path / "r.csv", "a,b\n1,2\n3,4\n1,2\n")
    first, again = (rows(rg.read_register(spark, path), "record_id", "row_idx") for _ in range(2))
    assert first == again and len({r[0] for r in first}) == 3
    digest = hashlib.sha256("1\x1f2\x1fr.csv".encode()).hexdigest()[:16]
    short = rows(rg.read_register(spark, path, id_digits=4), "record_id")
    assert (f"REC-0002-{digest[:4]}",) in short
    assert (f"REC-0002-{digest}", 2) in first and (f"REC-0004-{digest}", 4) in first


def test_made_ids_differ_between_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(5):
        write(folder / f"f{i}.csv", "a\n1\n")
    ids = [r[0] for r in rows(rg.read_register(spark, str(folder), id_digits=16), "record_id")]
    assert len(set(ids)) == 5 and all(len(i) == len("REC-0002-") + 16 for i in ids)


def test_a_split_file_keeps_its_row_numbers(spark, tmp_path):
    path = write(tmp_path / "big.csv", "id,t\n" + "".join(f"{i},{'x' * 40}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.csv(path).rdd.getNumPartitions() > 5
        raw = rg.read_register(spark, path, id_header="id", multi_line=False)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = raw.select("record_id", "row_idx").collect()
    assert len(got) == 5000 and all(int(r.record_id) + 2 == r.row_idx for r in got)


def test_many_splits_join_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS_MAX", 0)
    path = write(tmp_path / "r.csv", "id\na\nb\nc\n")
    assert rows(rg.read_register(spark, path, id_header="id"), "record_id", "row_idx") == [("a", 2), ("b", 3), ("c", 4)]


def test_repeated_headers_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        rg.read_register(spark, write(tmp_path / "r.csv", "原因,cause\n1,2\n"), ["原因", "cause"])


def test_csv_round_trip(spark, tmp_path):
    data = [("1", 'say "hi", ok'), ("2", "a\r\nb\nc"), ("3", None), ("4", ""), ("5", " lead"), ("6", "back\\slash")]
    sinks.write_csv(spark.createDataFrame(data, "id string, t string"), str(tmp_path / "out"))
    raw = rg.read_register(spark, str(tmp_path / "out"), ["id", "t"], id_header="id")
    assert rows(raw, "id_raw", "t_raw") == data


def test_fingerprints(spark, tmp_path):
    path = write(tmp_path / "r.csv", "x" * 100_000)
    assert rows(rg.file_fingerprints(spark, path)) == [("r.csv", 100_000, hashlib.sha256(b"x" * 100_000).hexdigest())]
    df = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, "a", "~")], "id int, s string, t string")
    assert len({r[1] for r in rows(rg.row_fingerprints(df, "id", ["s", "t"]))}) == 3


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([("a", "x"), ("b", "y")], "record_id string, v string")
    ids = spark.createDataFrame([("b",)], "record_id string")
    sinks.export_filtered(table, ids, str(tmp_path / "f"))
    sinks.export_judgments(ids.selectExpr("record_id", "'MATCH' judgment", "'why' reason", "1 extra"), str(tmp_path / "j"))
    sinks.export_statistics(spark.createDataFrame([("d", "c", 1, 100.0)], "dimension string, category string, count long, percentage double"), str(tmp_path / "s"))

    def back(name):
        return spark.read.option("header", True).csv(str(tmp_path / name))
    assert (back("f").columns, rows(back("f"))) == (["record_id", "v"], [("b", "y")])
    assert (back("j").columns, rows(back("j"))) == (["record_id", "judgment", "reason"], [("b", "MATCH", "why")])
    assert rows(back("s")) == [("d", "c", "1", "100.0")]
    stored = sinks.write_table(table, str(tmp_path / "t"))
    assert rows(stored) == [("a", "x"), ("b", "y")]
