import random
import zlib

import numpy as np
import pytest

from rollbook.llm import packing

pytest.importorskip("public_tokenizers")


def plain(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing._place(packing.TOKENIZER)).encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, ids_of):
    """Every id once, windows gapless, lengths full or powers of two."""
    by_doc, windows = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    for doc_id, pieces in by_doc.items():
        ids = ids_of[doc_id]
        pieces.sort(key=lambda r: r["start"])
        at = 0
        for r in pieces:
            part = np.array(ids[at:at + r["length"]], dtype="<u4")
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
        assert at == len(ids)
    assert set(by_doc) == set(ids_of)
    groups = {}
    for pieces in windows.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at == pieces[0]["window_length"] and at & (at - 1) == 0
        groups[pieces[0]["step_group"]] = groups.get(pieces[0]["step_group"], 0) + at
    assert max(groups.values(), default=0) <= packing.GROUP_IDS


def test_round_trip(spark, documents, words):
    rng = random.Random(3)
    stems = ["re", "on", "th", "é", "schaft", "ing", "."]
    texts = [words(rng, rng.choice([1, 5, 60, 400, 3000]), stems) for _ in range(120)]
    texts += ["", None, "a<|endoftext|>b", "日本語のテキスト と english", "x" * 30_000, " \n\n  \t ", "Ω≈ç√ 𠮷"]
    df = documents([(i, t, "en", "s") for i, t in enumerate(texts)])
    ids = {i: plain(t) for i, t in enumerate(texts)}
    for parts in (1, 5):
        rows = [r.asDict() for r in packing.pack(df.repartition(parts)).collect()]
        check(rows, ids)
    assert packing.pack(documents([])).count() == 0


def test_long_texts_are_cut_where_the_tokenizer_cuts(monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice(["ab", "c, d", "ef\n", "9", "gh"]) for _ in range(4000))
    whole = packing.encode(text)
    monkeypatch.setattr(packing, "PART_CHARS", 100)
    assert (packing.encode(text) == whole).all() and whole.tolist() == plain(text)[:-1]


@pytest.mark.parametrize("pool", [1, 5000, 1 << 20])
def test_packer_alone(pool):
    rng = random.Random(pool)
    packer = packing.Packer(3, pool_ids=pool)
    ids = {i: [rng.randint(0, 50_000) for _ in range(rng.choice([1, 2, 3, 40, 255, 256, 257, 1024, 1500, 2047, 2048, 2049, 5000]))] for i in range(150)}
    for i, own in ids.items():
        packer.add(i, np.array(own, dtype=np.uint32))
    packer.pack()
    packer.pack(last=True)
    names = [f.name for f in packing._ARROW]
    check([dict(zip(names, r)) for r in packer.drain()], ids)


def test_repeated_rows_are_documents_of_their_own(documents):
    rows = packing.pack(documents([(7, "same text", "en", "s")] * 3)).collect()
    assert sum(r.length for r in rows) == 3 * len(plain("same text"))


def test_step_groups_are_near_equal():
    """Of each window length, groups are full or, at the end of a task, at least half full and alike."""
    for documents in (1, 5, 41, 130, 333):
        packer = packing.Packer(3, group_ids=1 << 14)
        for i in range(documents):
            packer.add(i, np.arange(1, 700 + 37 * i % 5000, dtype=np.uint32))
        packer.pack(last=True)
        sizes = {}
        for *_, window, offset, size, group in packer.drain():
            if offset == 0:
                sizes.setdefault(size, {}).setdefault(group, []).append(window)
        groups = [g for of in sizes.values() for g in of]
        assert sorted(groups) == list(range(3 << 33, (3 << 33) + len(groups)))
        for size, of in sizes.items():
            counts = [len(of[g]) for g in sorted(of)]
            full = (1 << 14) // size
            uneven = [n for n in counts if n != full]
            assert max(counts) <= full and (len(counts) == 1 or min(counts) >= full // 2) and (not uneven or max(uneven) - min(uneven) <= 1)
