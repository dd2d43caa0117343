import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollbook.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed([int(x) for x in digits])):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else None,
            "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if good(k, m.group())] for k, p in PLAIN.items()}


def spans(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = {}
    for r in pii.with_spans(df).collect():
        out[r.i] = {k.name: [(s.start, s.stop) for s in r[f"_pii_{k.name}"]] for k in pii.KINDS}
    return out


TEXTS = [
    None, "", "no data here", "a@b.co+x@d.e.f,@g.h", "x" * 50_000 + "@", ("a.b-c_d" * 3000) + "@host.example.org",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 9" * 3, "+1 (132) 555-1352, +49-30-1234567. +12 +1------2", "4111 1111-1111 1111 and 4111111111111112",
    "é𠮷 4952935900253052 ü x@y.zz", " ".join(f"10.{i % 256}.0.{i % 300}" for i in range(3000)), "5" * 3000, "a." * 4000 + "@b." + "c." * 4000 + "d",
]


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(11)
    alphabet = "aZ0159.@+- ()_%é\n"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    got = spans(spark, texts)
    for i, text in enumerate(texts):
        want = brute(text)
        assert {k: got[i][k] for k in want} == want, repr(text)[:200]


def test_further_kinds_need_their_check_and_words(spark):
    texts = [
        "bank account GB82 WEST 1234 5698 7654 32 please", "GB82WEST12345698765433", "XGB82WEST12345698765432", "DE89370400440532013000",
        "SSN 123-45-6789", "part 123-45-6789", "ssn 000-45-6789", "amex card 378282246310005", "378282246310005", "order 378282246310005 card",
    ]
    got = spans(spark, texts)
    assert got[0]["iban"] == [(13, 40)] and got[3]["iban"] == [(0, 22)] and not got[1]["iban"] and not got[2]["iban"]
    assert got[4]["ssn"] == [(4, 15)] and not got[5]["ssn"] and not got[6]["ssn"]
    assert got[7]["shortcard"] == [(10, 25)] and not got[8]["shortcard"] and not got[9]["shortcard"]


def test_words_near_change_the_score(spark):
    df = spark.createDataFrame([(1, "reach me by mail a@b.co"), (2, "see a@b.co"), (3, "example a@b.co")], "i int, text string")
    got = {r.i: r.s for r in pii.with_spans(df).select("i", pii.best_score().alias("s")).collect()}
    assert got[1] == 1.0 and got[2] == 0.9 and abs(got[3] - 0.6) < 1e-9


def test_redaction(spark):
    texts = ["x@y.zz or 10.0.0.1!", "clean text, 12 items", None, "", "call +1 (132) 555-1352 now; 999.1.1.1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.t for r in pii.redact(df).select("i", F.col("text").alias("t")).collect()}
    assert got == {0: "<EMAIL> or <IP>!", 1: texts[1], 2: None, 3: "", 4: "call <PHONE> now; 999.1.1.1"}


def test_no_python_in_the_plan(spark):
    df = pii.with_spans(spark.createDataFrame([], "doc_id long, text string")).select(pii.all_spans().alias("a"), F.sha2(pii.all_spans(base_only=True), 256).alias("b"))
    assert df.count() == 0 and "Python" not in df._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="0123456789", min_size=16, max_size=19))
def test_luhn_by_hand(digits):
    flipped = digits[:-1] + str((int(digits[-1]) + 1) % 10)
    assert not (luhn(digits) and luhn(flipped))
