import re
import unicodedata

import duckdb
import pytest
from conftest import rows
from pyspark.sql import functions as F

from rollbook.functions import text as tx


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"))).first()[0]


@pytest.mark.parametrize("raw, clean", [
    ("　Ｒｏｏｍ　４２　ｶｷﾞ　", "Room 42 カギ"),
    (" first row \r\n\r\n  next   row,  tidy  \n", "first row\n\nnext row, tidy"),
    ("倉庫の鍵が見当たらない。", "倉庫の鍵が見当たらない。"),
    ("a\rb\t\tc", "a\nb c"),
    ("été", "été"),
    (None, None), ("", None), ("   \n \t  ", None), ("　", None),
])
def test_clean_text(spark, raw, clean):
    assert one(spark, raw, tx.clean_text) == clean


def test_search_shadow(spark):
    assert one(spark, " Ｌａｔｅ 到着 ", tx.search_shadow) == "late 到着"
    assert tx.fold_literal(" Ｌａｔｅ 到着 ") == "late 到着"
    for raw in (" a \r\n b\t\tc ", "Ａ  B", "x\n\ny "):
        assert tx.fold_term(raw) == one(spark, raw, tx.search_shadow)


def test_every_character_that_skips_python_is_stable():
    members = re.compile(f"[{tx.NFKC_STABLE}]")
    for code in range(0x10000):
        ch = chr(code)
        if not 0xD800 <= code <= 0xDFFF and members.match(ch):
            assert unicodedata.normalize("NFKC", ch) == ch and unicodedata.combining(ch) == 0, hex(code)


def test_pairs_of_stable_characters_do_not_compose():
    members = re.compile(f"[{tx.NFKC_STABLE}]")
    for code in range(0x10000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            assert not all(members.match(chr(int(p, 16))) for p in parts), hex(code)


def test_dates_and_numbers(spark):
    dates = {"2025-01-15": True, "2025/1/5": True, "1998-10-03 00:00:00": True, "2025-02-30": False, "2025": False, "12": False, None: False}
    numbers = {"10": True, "-1.5e3": True, ".5": True, "1d": False, "NaN": False, "": False, "1,5": False, None: False}
    df = spark.createDataFrame([(k,) for k in dates], "t string")
    assert dict(df.select("t", tx.looks_like_date(F.col("t"))).collect()) == dates
    df = spark.createDataFrame([(k,) for k in numbers], "t string")
    assert dict(df.select("t", tx.looks_like_number(F.col("t"))).collect()) == numbers


def test_percentage_matches_sql_rounding(spark):
    totals = [7, 32, 200, 1000, 32000]
    pairs = [(c, t) for t in totals for c in range(0, t + 1, max(1, t // 400))]
    df = spark.createDataFrame(pairs, "c long, t long").select("c", "t", tx.percentage(F.col("c"), F.col("t")))
    got = {(c, t): p for c, t, p in df.collect()}
    con = duckdb.connect()
    for c, t in pairs:
        assert got[c, t] == con.execute("SELECT round(?::BIGINT * 100.0 / ?::BIGINT, 2)", [c, t]).fetchone()[0]


def test_distinct_key_tells_texts_apart(spark):
    values = ["", "a", "A", "x" * 31, "x" * 32, "x" * 33, "é" * 16, None]
    keys = [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(tx.distinct_key(F.col("t"))).collect()]
    assert len({bytes(k) if k is not None else None for k in keys}) == len(values)
    assert max(len(k) for k in keys if k is not None) == 32


def test_any_contains_is_literal(spark):
    df = spark.createDataFrame([("50%",), ("5_0",), ("500",), (None,)], "t string")
    assert rows(df.filter(tx.any_contains(F.col("t"), ["0%", "_"]))) == [("50%",), ("5_0",)]
