"""Spelling variants against a plain walk over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rollbook.llm import spelling
from rollbook.llm.queries import QUERIES


def plain_words(rows, slip=True):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if slip and doc_id is not None and h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(n):
    out, form = {}, {}
    for w in n:
        own = [v for v in n if abs(len(v) - len(w)) <= 1 and near(w, v)]
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = len(own)
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, n[w], out[w], form[w], n[form[w]] if form[w] else None, root))
    return sorted(rows)


def corpus(seed=1, docs=60):
    rng = random.Random(seed)
    stems = ["ing", "tion", "é", "schaft", "re", "ab", "ba", "ÿ", "ÀÉ", "the"]
    base = ["".join(rng.choice(stems) for _ in range(rng.randint(3, 6))) for _ in range(40)]
    letters = "abegtÿé×"

    def slip(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[i:] + w[:i]])

    rows = []
    for d in range(docs):
        picked = [rng.choice(base[:1 + rng.randrange(40)]) for _ in range(60)]
        picked = [slip(w) if rng.random() < 0.15 else w for w in picked]
        rows.append((d, " ".join(w.upper() if rng.random() < 0.1 else w for w in picked)))
    rows += [(900, None), (901, ""), (None, " ".join(base)), (902, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 5001 + " " + "x" * 5001)]
    return rows + rows[:3]


@pytest.fixture
def build(documents):
    return lambda rows: documents([(i, t, "en", "s") for i, t in rows])


@pytest.mark.parametrize("parts,piece,run", [(None, 2048, 1024), (5, 3, 1), (3, 7, 50)])
def test_equals_all_pairs(build, monkeypatch, parts, piece, run):
    monkeypatch.setattr(spelling, "RUN_WORDS", run)
    monkeypatch.setattr(spelling.near_words, "__defaults__", (parts, piece))
    rows = corpus()
    words = spelling.materialise(spelling.vocabulary(build(rows).repartition(3), alter=spelling.slips))
    n = plain_words(rows)
    assert {r.word: r.n for r in words.collect()} == n
    want = plain_variants(n)
    got = sorted(tuple(r) for r in spelling.variants(words, parts=parts).select("word", "n", "n_near", "form", "form_n", "root").collect())
    assert got == want and sum(r[2] for r in want) > 150 and sum(r[3] is not None for r in want) > 10


def test_query(spark, tmp_path):
    """The registered query over a small table."""
    rows = corpus(2, 25)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_spelling"](spark, str(tmp_path)).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(tuple(r) for r in got) == plain_variants(plain_words(rows))


def test_chains(spark):
    data = [("abcdefgh", 50_000), ("abcdefg", 5_000), ("bcdefgh", 5_000), ("abcdefx", 400), ("abcdexx", 40), ("abcdxxx", 4), ("abcxxxx", 4)]
    words = spelling.materialise(spark.createDataFrame(data, "word string, n long"))
    found = {r.word: (r.n_near, r.form, r.root) for r in spelling.variants(words).collect()}
    assert found["abcdxxx"] == (2, "abcdexx", "abcdefgh") and found["abcxxxx"] == (1, None, "abcxxxx")
    assert found["abcdefg"] == (2, "abcdefgh", "abcdefgh")


def test_empty(build):
    assert spelling.variants(spelling.materialise(spelling.vocabulary(build([])))).count() == 0
    assert spelling.variants(spelling.materialise(spelling.vocabulary(build([(1, "short"), (2, None)])))).count() == 0


def test_one_edit():
    rng = random.Random(9)
    words = ["".join(rng.choice("ab") for _ in range(n)) for n in (5, 6) for _ in range(60)]
    for la, lb in ((5, 5), (6, 6), (5, 6)):
        a, b = [w for w in words if len(w) == la], [w for w in words if len(w) == lb]
        pairs = [(x, y) for x in a for y in b]
        code = [np.array([[ord(c) for c in w] for w in side], dtype=np.uint8) for side in zip(*pairs)]
        assert spelling.one_edit(*code).tolist() == [near(x, y) for x, y in pairs]


def test_more_words_make_finer_blocks():
    assert [spelling.parts_for(n) for n in (0, 1 << 20, (1 << 20) + 1, 1 << 23, 1 << 27)] == [4, 4, 4, 5, 6]
