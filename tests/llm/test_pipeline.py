import random

import corpus_pipeline as cp
from rollbook.llm import mixing, packing
from rollbook.session import materialise


def corpus(words):
    rng = random.Random(12)
    stems = {"en": ["the", "ing", "tion", "re"], "de": ["sch", "keit", "ung", "über"]}
    rows = [(i, words(rng, rng.randint(30, 200), stems[g]), g, f"s{i % 5}") for i, g in enumerate(["en", "de"] * 60)]
    rows += [(200 + i, rows[i][1] + " extra", rows[i][2], "s1") for i in range(10)] + [(300 + i, rows[i][1], rows[i][2], None) for i in range(10)]
    rows += [(400, "1234 5678 !!", "en", "s0"), (401, None, "en", "s0"), (402, "", "de", "s0"), (403, words(rng, 60, stems["en"]) + " write to a@b.co now", "en", "s2")]
    rows += [(3, rows[3][1], "de", "s3"), (None, words(rng, 50, stems["de"]), "de", "s4")]
    return rows


def test_stages(spark, documents, words):
    docs = documents(corpus(words))
    kept = []
    for name, stage in cp.STAGES[:-1]:
        after = materialise(stage(spark, docs, "unused"))
        assert after.columns == docs.columns, name
        kept.append([r.doc_id for r in after.collect()])
        docs = after
    language, single, redacted, mixed = kept
    assert set(language) == {r[0] for r in corpus(words)} - {400, 401, 402}
    assert sorted(map(str, single)) == sorted(map(str, [*range(120), 403, None])) and len(single) == len(set(single))
    assert sorted(map(str, redacted)) == sorted(map(str, single))
    texts = {r.doc_id: r for r in docs.collect()}
    if 403 in texts:
        assert "a@b.co" not in texts[403].text and "<EMAIL>" in texts[403].text and texts[403].n_chars == len(texts[403].text)
    assert set(mixed) <= set(redacted) and max(mixed.count(i) for i in set(mixed)) <= 2
    packed = cp.STAGES[-1][1](spark, docs, "unused").collect()
    assert sum(r.length for r in packed) == sum(len(packing.encode(t.text)) + 1 for t in docs.collect())


def test_short_texts_unlike_every_language_go(spark, documents, words):
    rows = [r for r in corpus(words) if r[0] is not None and r[0] < 120]
    rng = random.Random(5)
    fine = [(500 + i, words(rng, 3 + i, ["the", "ing", "tion", "re"]), "en", "s") for i in range(10)]
    other = [(600 + i, " ".join("".join(rng.choice("qxzjvkwy") for _ in range(6)) for _ in range(3 + i)), "en", "s") for i in range(10)]
    docs = documents(rows + fine)
    assert cp.identify_language(spark, docs, "unused").count() == len(rows) + len(fine)
    kept = {r.doc_id for r in cp.identify_language(spark, documents(rows + [(i, t, None, s) for i, t, _, s in fine + other]), "unused").collect()}
    assert kept == {r[0] for r in rows + fine}


def test_near_copies_share_four_fifths_of_their_passages(spark, documents):
    body = [f"w{i}" for i in range(104)]
    scattered = [f"x{i}" if i in (10, 50) else w for i, w in enumerate(body)]
    texts = [body, body + [f"t{i}" for i in range(15)], scattered, body + [f"u{i}" for i in range(40)], [f"z{i}" for i in range(30)]]
    docs = documents([(i, " ".join(t), "en", "s") for i, t in enumerate(texts)])
    assert sorted(r.doc_id for r in cp.drop_near_copies(spark, docs, "unused").collect()) == [0, 3, 4]


def test_one_row_of_each_group_stays(spark, documents):
    a, c = [" ".join(f"{x}{i}" for i in range(100)) for x in "ac"]
    rows = [(1, a), (5, a + " more"), (5, c), (7, c + " more"), (None, a + " yet"), (None, c), (1, a + " other"), (None, "alone here now"), (None, "alone here now")]
    kept = cp.drop_near_copies(spark, documents([(i, t, "en", "s") for i, t in rows]), "unused").collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in kept) == [(0, "a"), (1, "a"), (5, "c")]


def test_the_mix_is_near_its_targets(spark, documents, words):
    docs = documents(corpus(words)[:120])
    plan = {r.source: r._mix_target for r in mixing.mix(docs, keep=["source"]).collect()}
    taken = {}
    for r in cp.mix_sources(spark, docs, "unused").collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    for source, target in plan.items():
        assert abs(taken.get(source, 0) - target) <= 0.05 * target + 5


def test_empty_documents(spark, documents):
    docs = documents([])
    for _, stage in cp.STAGES:
        assert stage(spark, docs, "unused").count() == 0
