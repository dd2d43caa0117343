"""Lines of many documents against a plain walk, with the index whole and shard by shard."""

import random
from collections import defaultdict

import numpy as np
import pytest

from rollbook.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def plain(rows, documents=5, chars=40):
    def key(line):
        line = line.strip(SPACE)
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)

    held = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None:
                held[key(line)].add(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= chars and len(held[key(x)]) >= documents and max(held[key(x)]) != doc_id)]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    common = ["All Rights Reserved by the makers of this page %d" % i for i in range(12)]
    common += ["é" * 39, "é" * 40, "É" * 40, "x" * 39, "x" * 40, "  " + "y" * 40 + "\t", "　" + "z" * 40]
    rows = []
    for i in range(90):
        lines = [rng.choice([rng.choice(common), rng.choice(common).upper() + " \r", "own line %d of the text number %d here" % (i, j), "", "short"])
                 for j in range(rng.randint(0, 14))]
        rows.append((i * 3 - 30, "\n".join(lines), "en", "s"))
    rows += [(1000 + i, common[0] + "\n" + common[0], "en", "s") for i in range(60)]     # hot line
    rows += [(5000, common[1] + "\n" + common[1] + "\nrest", "en", "s")] * 3             # rows of one document
    rows += [(None, common[0] + "\nrest of it", "en", "s"), (None, None, "en", "s"), (7777, None, "en", "s"), (7778, "", "en", "s")]
    rows += [(0, common[2] + "\nkeeps the rest", "en", "s")]  # a NULL id is not the document 0
    rows += [(8000, "\n".join("line %d of a very long text, longer than forty" % (j % 900) for j in range(20_000)), "en", "s")]
    return rows


@pytest.mark.parametrize("index_bytes", [64 << 20, 0])
def test_equals_a_plain_walk(spark, documents, monkeypatch, index_bytes):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    rows = corpus()
    for parts in (1, 6):
        got = line_dedup.drop_lines(documents(rows).repartition(parts), index_bytes=index_bytes).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain(rows)


@pytest.mark.parametrize("index_bytes", [64 << 20, 0])
def test_edges(documents, index_bytes):
    assert line_dedup.drop_lines(documents([]), index_bytes=index_bytes).count() == 0
    rows = [(i, "nothing in common %d, although the lines are long" % i, "en", "s") for i in range(9)]
    got = line_dedup.drop_lines(documents(rows), index_bytes=index_bytes).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)
    rows = [(i, "held by four documents alone, and so it has to stay", "en", "s") for i in range(4)] * 2
    assert {r.n_dropped for r in line_dedup.drop_lines(documents(rows), index_bytes=index_bytes).collect()} == {0}


@pytest.mark.parametrize("n", [1, 2, 63, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.empty(n, dtype=line_dedup._PAIR)
    keys["hi"], keys["lo"] = rng.integers(0, 1 << 63, n), np.arange(n)
    keys["hi"][:n // 2] = 7  # equal halves are told apart by the other one
    hashed = line_dedup.PerfectHash.of(keys)
    assert sorted(hashed.places(keys)) == list(range(n))
    assert len(hashed.words) * 64 <= 8 * n + 64 * len(hashed.bits)
    other = keys.copy()
    other["lo"] += np.uint64(1 << 40)
    assert ((hashed.places(other) >= -1) & (hashed.places(other) < n)).all()
