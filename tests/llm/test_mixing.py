import pytest
from pyspark.sql import functions as F

from rollbook.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Water filling by repetition: capped sources leave, the rest share again."""
    budget, open_, out = share * sum(sizes), list(range(len(sizes))), {}
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        over = [i for i in open_ if budget * weights[i % len(weights)] / total >= most * sizes[i]]
        if not over:
            return [out.get(i, budget * weights[i % len(weights)] / total) for i in range(len(sizes))]
        for i in over:
            out[i] = most * sizes[i]
            budget -= most * sizes[i]
            open_.remove(i)
    return [out[i] for i in range(len(sizes))]


def run(df, **how):
    got = mixing.mix(df, keep=["doc_id", "source"], **how).collect()
    return [(r.doc_id, r.source, r._mix_size, r._mix_source_size, r._mix_target, r._mix_copies) for r in got]


@pytest.mark.parametrize("hot", [1, 40])
def test_targets_and_copies(documents, hot):
    rows = [(i, "w " * (1 + i * 37 % 97), "en", f"s{i % 7}" if i % hot else "s0") for i in range(900)]
    got = run(documents(rows))
    assert len(got) == 900 and got and sorted(got) == sorted(run(documents(rows[::-1])))
    sizes = {}
    for i, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    names = sorted(sizes)
    want = dict(zip(names, targets([sizes[n] for n in names])))
    for name in names:
        own = [r for r in got if r[1] == name]
        assert all(abs(r[4] - want[name]) < 1e-6 * want[name] and r[3] == sizes[name] and 0 <= r[5] <= 2 for r in own)
        taken = sum(r[2] * r[5] for r in own)
        assert abs(taken - want[name]) <= 20, (name, taken, want[name])


def test_awkward_rows(documents):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "one two", None, None), (None, "three", "en", "ü"), (5, "x " * 100_000, "en", "b"),
            (6, "same row", "en", "c"), (6, "same row", "en", "c"), (7, "\t\n ", "en", "c")]
    got = run(documents(rows))
    assert len(got) == len(rows) and {r[2] for r in got} == {0, 1, 2, 100_000}
    assert len({r for r in got if r[0] == 6}) == 1
    assert run(documents([])) == []
    whole = mixing.mix(documents(rows))
    assert whole.columns[:9] == documents(rows).columns and whole.filter("score = 'x' AND size = 'y' AND key = 'z' AND gap = 'w'").count() == len(rows)


def test_one_id_holds_most_rows(documents):
    rows = [(1, "a b c", "en", "s")] * 600 + [(i, "d e", "en", "s") for i in range(2, 300)] + [(i, "f " * 5, "en", "t") for i in range(300, 400)]
    got = run(documents(rows))
    assert len(got) == len(rows) and len({r[5] for r in got if r[0] == 1}) == 1


def test_word_counts_follow_the_rule(spark):
    texts = ["", " ", "a", " a b c\n\td\x0b", "\x1cx y", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(df.select("i", mixing.word_count("t")).collect())
    assert got == {0: 0, 1: 0, 2: 1, 3: 3, 4: 2, 5: 0}
    assert "Python" not in df.select(F.sum(mixing.word_count("t")))._jdf.queryExecution().executedPlan().toString()
