"""Two tokenizers' tokens against a plain walk over all pairs of byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from rollbook.llm import alignment
from rollbook.llm.queries import QUERIES

pytest.importorskip("public_tokenizers")


def plain(rows):
    """The contract token by token; whole texts, no windows, no memory."""
    both = alignment.tokenizers()
    letters = alignment._byte_letters()
    aligned, count = [], Counter()
    for doc_id, text in rows:
        a = both.a.encode(" " + (text or ""), add_special_tokens=False)
        ids_b = both.b.encode(text or "")
        bytes_a = [bytes(letters[c] for c in both.a.id_to_token(i)) for i in a.ids]
        pieces = [both.b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:-1], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            aligned.append((doc_id, [], [], [], []))
            continue
        spans = []
        for ids, parts in ((a.ids, bytes_a), (ids_b, bytes_b)):
            at, own = 0, []
            for i, p in zip(ids, parts):
                own.append((at, at + len(p), i))
                at += len(p)
            spans.append(own)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if max(x[0], y[0]) < min(x[1], y[1])]
        shared = {x[1] for x in spans[0]} & {y[1] for y in spans[1]}
        groups, last = [], 0
        for end in sorted(shared):
            groups.append("|".join(",".join(str(x[2]) for x in side if last <= x[0] < end) for side in spans))
            last = end
        count.update(links)
        aligned.append((doc_id, a.ids, ids_b, groups, links))
    high = defaultdict(int)
    for (_, b), n in count.items():
        high[b] = max(high[b], n)
    return sorted(((
        d, len(a), len(b), len(groups), len(links), sum(count[x] == high[x[1]] for x in links), sum(count[x] for x in links),
        hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") for d, a, b, groups, links in aligned), key=str)


def corpus(words, n=60):
    rng = random.Random(12)
    stems = ["re", "on", "th", "é", "schaft", "ing", ".", "ñ", "Ü", "1", "x,"]
    rows = [(i, words(rng, rng.choice([1, 3, 30, 120]), stems)) for i in range(n)]
    odd = ["", None, " ", "  two  spaces ", "\n\nlines\r\n\ttabs\n", "a<|endoftext|>b </s> <s> <unk> <0x41>", "mark ▁ here", "日本語 の テキスト", "𠮷 Ω≈ç√ ﬁ ①",
           "no-break space", "é combining", "\x00 nul", "x" * 3000, "。" * 50, " leading", "trailing ", "123456 7,8.9", "ünder_score camelCase"]
    return rows + [(1000 + i, t) for i, t in enumerate(odd)] + [(None, "nobody's text"), (5, rows[5][1])]


COLUMNS = ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block,part,memo", [(4 << 20, 1 << 18, 1 << 18), (500, 200, 10)])
def test_equals_a_plain_walk(documents, words, monkeypatch, block, part, memo):
    for name, value in (("BLOCK_BYTES", block), ("PART_CHARS", part), ("MEMO_WINDOWS", memo)):
        monkeypatch.setattr(alignment, name, value)
    rows = corpus(words)
    found, pairs = alignment.align_documents(documents([(i, t, "en", "s") for i, t in rows]).repartition(3))
    got = sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=str)
    want = plain(rows)
    assert got == want and sum(r[1] > 0 for r in want) > 60
    assert pairs.agg({"count": "sum"}).first()[0] == sum(r[4] for r in want)


def test_query(spark, words, tmp_path):
    rows = corpus(words, 20)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_alignment"](spark, str(tmp_path)).select("doc_id", *COLUMNS[1:]).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_empty(documents):
    found, pairs = alignment.align_documents(documents([]))
    assert found.count() == 0 and pairs.count() == 0
    found, pairs = alignment.align_documents(documents([(1, None, "en", "s")]))
    assert [tuple(r) for r in found.select(*COLUMNS).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] and pairs.count() == 0


def test_long_texts_are_cut_where_both_cut(words, monkeypatch):
    rng = random.Random(8)
    text = words(rng, 3000, ["ab", "c, d", "ef\n", "9", "gh", "é"])
    both = alignment.tokenizers()
    [whole] = list(both.encode([text]))
    monkeypatch.setattr(alignment, "PART_CHARS", 60)
    [cut] = list(both.encode([text]))
    assert len(list(both._parts(text))) > 50
    assert all((x == y).all() for x, y in zip(whole, cut)) and len(whole[0]) > 3000


def test_windows_are_aligned_once():
    both = alignment.tokenizers()
    windows = alignment.Windows(both)
    [(a, b)] = list(both.encode([("the same words " * 40).strip()]))
    own = windows.of(a, b)
    assert len(own) == 120 and len(windows.new) == 3
    windows.settle()
    assert len(windows.texts) == 3 and windows.of(a, b) == own and not windows.new
    i, j = alignment.anchors(a, b, both.of_a, both.of_b)
    assert i[0] == j[0] == 0 and i[-1] == len(a) and j[-1] == len(b)
    assert (np.cumsum(both.of_a.sizes[a])[i[1:] - 1] == np.cumsum(both.of_b.sizes[b])[j[1:] - 1]).all()


def test_the_faster_implementation_gives_the_same_ids():
    """Random strings over all characters that go through it."""
    both = alignment.tokenizers()
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0x80), 32])) for _ in range(rng.randint(1, 40)))
        assert both.fast is not None and both._first(text).tolist() == both.a.encode(" " + text, add_special_tokens=False).ids
    assert both._first("a<|endoftext|>b").tolist() == both.a.encode(" a<|endoftext|>b", add_special_tokens=False).ids


def test_a_block_holds_few_bytes(monkeypatch):
    """Numbers of windows and links travel compressed, and come back as they were; texts are read in parts."""
    rng = np.random.default_rng(1)
    for numbers in (np.empty(0, np.int64), np.array([0, 1, 2**32 - 1]), rng.integers(0, 5000, 9000)):
        assert (alignment._unpacked(alignment._packed(numbers)) == numbers).all()
    monkeypatch.setattr(alignment, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("U", (), {"partitionId": staticmethod(lambda: 2)}))}))
    monkeypatch.setattr(alignment, "PART_CHARS", 3000)
    words = [f"{a}{b}" for a in ("stone", "river", "cloud", "under") for b in ("s", "ed", "ing", "", "er")]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(60)] + ["", None]
    batch = alignment.pa.RecordBatch.from_pydict({"id": list(range(61)) + [None], "text": texts})
    [block] = alignment._blocks(iter([batch]), alignment.BYTE_LEVEL, alignment.PIECES)
    row = block.to_pylist()[0]
    assert row["block"] == 2 << 32 and row["ids"] == [*range(61), None] and row["groups_sha256"][-2:] == ["", ""]
    assert len(alignment._unpacked(row["windows"])) == alignment._unpacked(row["sizes"]).sum() == sum(len(t.split()) for t in texts if t)
    assert len(row["windows"]) < 2 * 18_000
