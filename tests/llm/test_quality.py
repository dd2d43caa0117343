import random

import numpy as np

from rollbook.llm import quality as ql


def brute(text):
    text = text or ""
    white = " \t\n\x0b\x0c\r"
    words = text.encode().split()
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(white):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(c not in white for c in text), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def test_statistics_equal_a_plain_walk(spark, documents, words):
    rng = random.Random(9)
    texts = ["", None, "a", "a b c a b c", "x\nx\n \n\nx \nx", "A b C A B c", "é é é é", "# | <p>& 100%", "\x1cword x", "w " * 30_000, "a a a a"]
    texts += ["\n".join(words(rng, rng.randint(0, 12), ["a", "b", "é"]) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    df = documents([(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r.doc_id: tuple(r)[1:6] for r in ql.statistics(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert ql.statistics(documents([])).count() == 0


def table(n, seed):
    rng = np.random.default_rng(seed)
    return {name: rng.random(n) for name in ql.features()}


def test_a_planted_conjunction_is_found():
    values = table(3000, 1)
    bad = (values["symbols_per_word"] > 0.8) & (values["upper_case"] > 0.5)
    rules = ql.learn(values, bad)
    hit = np.zeros(3000, dtype=bool)
    for rule in rules:
        hit |= ql._covered(rule, values, 3000)
    assert {c.feature for c in rules[0]} == {"symbols_per_word", "upper_case"}
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.02 * (~bad).sum()


def test_noise_gives_no_rule():
    assert ql.learn(table(2000, 2), np.random.default_rng(3).random(2000) < 0.1) == []


def test_a_rule_from_few_bad_rows():
    values = table(600, 4)
    bad = np.zeros(600, dtype=bool)
    bad[::60] = True  # ten rows
    values["symbols_per_word"][bad] += 1.5
    rules = ql.learn(values, bad)
    hit = np.zeros(600, dtype=bool)
    for rule in rules:
        hit |= ql._covered(rule, values, 600)
    assert (hit & bad).sum() == 10 and not (hit & ~bad).any()


def test_chance_is_the_binomial_tail():
    import itertools
    import math
    share, n = 0.3, 6
    for p in range(n + 1):
        plain = sum(math.prod(share if x else 1 - share for x in draw) for draw in itertools.product((0, 1), repeat=n) if sum(draw) >= p)
        assert math.isclose(ql.by_chance(p, n, share), plain, rel_tol=1e-9)
    assert ql.by_chance(1, 3, 0.0) == 0.0 and ql.by_chance(3, 3, 1.0) == 1.0


def test_verdicts_equal_a_plain_walk_over_the_rules(spark, documents, words):
    rng = random.Random(12)
    texts = [words(rng, rng.randint(0, 90), ["ab", "C", "#", "9", "!"]) for _ in range(120)] + ["", None, "x " * 40_000]
    measured = ql.statistics(documents([(i, t, "en", "s") for i, t in enumerate(texts)])).cache()
    rules = [(ql.Condition("symbols_per_word", True, 0.5), ql.Condition("words", True, 20.0)), (ql.Condition("word_length", False, 3.0),),
             (ql.Condition("digits", True, 0.2), ql.Condition("upper_case", False, 0.1))]
    rows = measured.select("doc_id", ql.verdict(rules).alias("kept"), *[c.alias(n) for n, c in ql.features().items()]).collect()

    def kept(row):
        for rule in rules:
            if all(row[c.feature] > c.cut if c.above else row[c.feature] <= c.cut for c in rule):
                return False
        return True

    assert len({r.kept for r in rows}) == 2
    assert [r.kept for r in rows] == [kept(r) for r in rows]


def test_rules_run_as_expressions(spark, documents):
    clean = "\n".join(" ".join(f"word{i * 20 + j}" for j in range(20)) for i in range(4))
    rows = [(i, clean.replace("word", f"w{i}x"), "en", "s") for i in range(200)] + [
        (1000 + i, " ".join(f"w{i}y{j}###" for j in range(80)), "en", "s") for i in range(100)] + [(5000, "short", "en", "s")]
    labels = spark.createDataFrame([(i, 0 if i >= 1000 else 1, None) for i in [*range(200), *range(1000, 1100), *range(3)]] + [(7, None, None)],
                                   "doc_id long, quality int, score string")
    measured = ql.statistics(documents(rows)).cache()
    rules = ql.learn_rules(measured, labels)
    kept = {r.doc_id: r.k for r in measured.select("doc_id", ql.verdict(rules).alias("k")).collect()}
    assert rules and all(kept[i] for i in range(200)) and not any(kept[i] for i in range(1000, 1100))
    assert ql.learn_rules(measured, labels.limit(0)) == [] and ql.learn_rules(measured, labels.filter("quality = 1")) == []
    assert len({tuple(ql.learn_rules(measured.repartition(n), labels)) for n in (1, 7)}) == 1
