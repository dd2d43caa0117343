import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollbook.llm import ngram_join as nj
from rollbook.llm.textkernel import as_bytes, windows, word_hashes


def grams(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < n else [tuple(words[i:i + n]) for i in range(len(words) - n + 1)])


def brute(rows, percent=90, n=3):
    """(id, set size, smallest id of the group) by comparing all pairs."""
    sets = [(i, grams(t, n)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    out = []
    for a, (i, s) in enumerate(sets):
        ids = [sets[b][0] for b in range(len(rows)) if find(b) == find(a) and sets[b][0] is not None]
        out.append((i, len(s), (min(ids) if ids else None) if s else i))
    return sorted(out, key=str)


def run(documents, rows, **how):
    df = documents([(i, t, "en", "s") for i, t in rows])
    return sorted(((r.id, r.n_grams, r.group_id) for r in nj.near_groups(df, **how).collect()), key=str)


def near_copies(rng, words, n, changes):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, changes)):
            copy[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("least, few, block, hubs", [(nj.FREQUENT_LEAST, nj.FEW_MEMBERS, nj.BLOCK_MEMBERS, nj.HUB_ROUNDS), (0, 2, 7, 0)])
def test_equals_comparing_all_pairs(documents, monkeypatch, least, few, block, hubs):
    monkeypatch.setattr(nj, "FREQUENT_LEAST", least)
    monkeypatch.setattr(nj, "FEW_MEMBERS", few)
    monkeypatch.setattr(nj, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(nj, "HUB_ROUNDS", hubs)
    rng = random.Random(least)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = near_copies(rng, 120, 60, 3) + near_copies(rng, 40, 30, 2) + near_copies(rng, 400, 25, 14)
    texts += [passage + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [passage + f" tail{i % 4}" for i in range(12)]
    texts += ["Same TEXT here", "same text HERE", "a b", "A B", "a", "b", "", None, " \n", "a b c d e f g h i j k", "a b c d e f g h i j k l", "é É x y", "É é x y"]
    rng.shuffle(texts)
    rows = [(100 + 3 * i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (None, texts[1]), (None, "alone here now")]
    assert run(documents, rows) == brute(rows)


@pytest.mark.parametrize("least, few, block, hubs", [(nj.FREQUENT_LEAST, nj.FEW_MEMBERS, nj.BLOCK_MEMBERS, nj.HUB_ROUNDS), (0, 2, 7, 0)])
def test_other_lengths_and_thresholds_equal_comparing_all_pairs(documents, monkeypatch, least, few, block, hubs):
    monkeypatch.setattr(nj, "FREQUENT_LEAST", least)
    monkeypatch.setattr(nj, "FEW_MEMBERS", few)
    monkeypatch.setattr(nj, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(nj, "HUB_ROUNDS", hubs)
    rng = random.Random(least + 1)
    texts = near_copies(rng, 120, 40, 5) + near_copies(rng, 40, 30, 2) + near_copies(rng, 400, 25, 16)
    base = [f"v{i}" for i in range(100)]
    texts += [" ".join(base[:k]) for k in (100, 84, 83, 67, 9, 8, 7, 5, 4, 3)] + ["a b c d", "A b c d", "a b c", "", None]
    rows = [(100 + 3 * i, t) for i, t in enumerate(texts)] + [(None, texts[1])]
    assert run(documents, rows, percent=80, n=5) == brute(rows, 80, 5)


def test_empty_table(documents):
    assert run(documents, []) == []


def test_one_text_in_most_rows(documents):
    rows = [(i, "the very same words again and again here") for i in range(300)] + [(1000 + i, f"other {i} text {i} words {i}") for i in range(50)]
    assert run(documents, rows) == brute(rows)


def test_a_very_long_text_and_a_near_copy(documents):
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 10**7)}" for _ in range(150_000)]
    other = list(words)
    for i in range(0, 150_000, 100):
        other[i] = "zz"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[::-1]))]
    assert [(i, g) for i, _, g in run(documents, rows)] == [(1, 1), (2, 1), (3, 3)]


@settings(max_examples=150, deadline=None)
@given(st.integers(9, 900), st.integers(0, 10**6), st.floats(0, 1), st.integers(0, 60))
def test_close_sets_share_a_signature(size, seed, often, drop):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**63, size * 2, dtype=np.uint64))
    x = np.sort(rng.permutation(pool)[:size])
    steps = np.where(rng.random(1 << 12) < often, 90, rng.integers(0, 60, 1 << 12)).astype(np.uint8)
    sketch = nj.Sketch(steps, 60)
    changes = rng.permutation(len(x))[:drop * size // 1000]
    y = np.unique(np.concatenate([np.delete(x, changes), rng.integers(0, 2**63, drop * size // 1500, dtype=np.uint64)]))
    both = len(np.intersect1d(x, y))
    if 100 * both >= 90 * (len(x) + len(y) - both) and both < max(len(x), len(y)):
        assert len(np.intersect1d(nj.signatures(x, sketch), nj.signatures(y, sketch)))
    difference = len(np.setxor1d(x, y))
    assert nj.least_difference(nj.bitmap(x), nj.bitmap(y)) <= difference


def test_signatures_grow_with_the_set():
    rng = np.random.default_rng(0)
    for size in (100, 3000, 40_000):
        grams_ = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        for frequent in (0, 60):
            assert len(nj.signatures(grams_, nj.Sketch(np.full(1 << 10, 40, np.uint8), frequent))) < 8 * size


def test_words_follow_the_rule():
    texts = ["One  two\tTHREE four", "", None, "a", " x\x1cy z "]
    got = [len(w) for w in word_hashes(as_bytes(texts))]
    assert got == [4, 0, 0, 1, 2]
    a, b = (next(iter(word_hashes(as_bytes([t])))) for t in ("One two three", "one TWO three"))
    assert (a == b).all() and len(windows(a, 3)) == 1 and len(windows(a[:2], 3)) == 1 and len(windows(a[:0], 3)) == 0


def test_links_of_large_groups_are_linear(spark, monkeypatch):
    """3,000 near copies of one text, none the base itself: what leaves the tasks grows with the members, not their pairs."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(3000):
        words = list(base)
        words[rng.randrange(50)] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    monkeypatch.setattr(nj, "HUB_ROUNDS", 0)
    counts = []
    whole = nj._links_of_many

    def counting(many, nodes, sets, percent):
        links = nj.materialise(whole(many, nodes, sets, percent))
        counts.append((links.count(), many.count()))
        return links
    monkeypatch.setattr(nj, "_links_of_many", counting)
    groups = nj.near_groups(docs)
    assert groups.select("group_id").distinct().count() == 1
    [(links, members)] = counts
    assert links <= 8 * members


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([90, 80]), st.integers(1, 900), st.integers(0, 10**6), st.integers(0, 220))
def test_close_sets_share_a_piece(percent, size, seed, drop):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
    y = np.unique(np.concatenate([x[drop * size // 1000:], rng.integers(0, 2**63, drop * size // 2000, dtype=np.uint64)]))
    both = len(np.intersect1d(x, y))
    if both and 100 * both >= percent * (len(x) + len(y) - both):
        x, y = sorted((x, y), key=len)
        lows = nj.size_tiers(2 * len(y), percent)
        own = nj.pieces(nj.bitmap(y), len(y), lows, percent)[0]
        assert len(np.intersect1d(own, np.concatenate(nj.pieces(nj.bitmap(x), len(x), lows, percent))))


def test_texts_of_one_cluster_are_dealt_few_times(spark, monkeypatch):
    """300 texts of one base, no two near: they share hundreds of signatures, but are not dealt for each of them."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(300):
        words = list(base)
        for i in rng.sample(range(150), 3):
            words[i] = f"x{rng.randint(0, 10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"o{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(nj, "BLOCK_MEMBERS", 32)
    made, whole = [], nj._dealt

    def counting(members, more, *columns):
        dealt = whole(members, more, *columns)
        made.append(dealt.count())
        return dealt
    monkeypatch.setattr(nj, "_dealt", counting)
    assert nj.near_groups(docs).select("group_id").distinct().count() == 600
    assert sum(made) < 60 * 300  # 54,852 when each large signature was dealt by itself
