import random

import numpy as np

from rollbook.llm import language as lg

STEMS = {"aa": ["the", "ing", "tion", "re"], "bb": ["sch", "keit", "ung", "über"], "cc": ["ção", "nho", "lha", "que"]}


def corpus(words, n=60, seed=1):
    rng = random.Random(seed)
    return [(i, words(rng, rng.randint(20, 80), STEMS[g]), g, "s") for i, g in enumerate(sorted(STEMS) * (n // 3))]


def test_bundles_are_sums_over_trigrams():
    first, rest = lg._vectors()
    text = "Abra, çA 9 x"
    want = np.zeros(lg.DIMENSION)
    numbers = lg._letter_numbers()
    codes = [0]
    for c in text.lower():
        n = int(numbers[ord(c)])
        if n or codes[-1]:
            codes.append(n)
    if codes[-1]:
        codes.append(0)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        want += first[a].astype(float) * rest[b * lg.LETTERS + c]
    assert np.allclose(lg.bundles([text])[0], want)
    assert not lg.bundles(["", "123 !?", " \n"]).any()


def test_long_texts_and_strips_agree(monkeypatch, words):
    rng = random.Random(2)
    texts = [words(rng, n, STEMS["bb"]) for n in (1, 30, 2000, 3)]
    whole = lg.bundles(texts)
    monkeypatch.setattr(lg, "STRIP_CHARS", 500)
    pieces = lg.bundles(texts)
    for a, b in zip(whole, pieces):
        assert a @ b / np.linalg.norm(a) / np.linalg.norm(b) > 0.999


def test_predictions(spark, documents, words):
    rows = corpus(words)
    profiles = lg.prototypes(documents([*rows, (900, "the ing tion", None, "s"), (901, None, "aa", "s")]))
    assert sorted(r.lang for r in profiles.collect()) == ["aa", "bb", "cc"]
    rng = random.Random(5)
    tests = [(i, words(rng, 30, STEMS[g]), g, "s") for i, g in enumerate(sorted(STEMS) * 5)]
    odd = [(100, None, "aa", "s"), (101, "", "aa", "s"), (102, "12 + 34", "bb", "s"), (103, "the " * 40_000, "aa", "s")]
    found = lg.identify(documents(tests + odd), profiles)
    assert found.columns[:9] == documents([]).columns
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in found.collect()}
    assert all(got[i][0] == g and 0.5 < got[i][1] <= 1 for i, _, g, _ in tests)
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "aa"


def test_without_labels_and_empty(spark, documents):
    none = lg.prototypes(documents([(1, "text", None, "s")]))
    assert [r.lang_pred for r in lg.identify(documents([(1, "text", "aa", "s")]), none).collect()] == ["und"]
    assert lg.identify(documents([]), none).count() == 0


def test_a_bounded_share_is_learned_from(spark, documents, words):
    few = lg.prototypes(documents(corpus(words, 300)), train_docs=20)
    assert sorted(r.lang for r in few.collect()) == ["aa", "bb", "cc"]


def test_held_out_rule(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in range(200)], "doc_id long")
    got = {r.doc_id: r.h for r in df.select("doc_id", lg.held_out("doc_id", 7, 2).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(200)}
