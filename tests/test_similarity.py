"""The similarity join against all pairs."""

import random

import pytest

from rollbook.operators import normalization as nz
from rollbook.operators import similarity
from rollbook.session import materialise


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(values, names, least):
    out = {}
    for v in values:
        distance, name = min((edits(v, n) / max(len(v), len(n)), n) for n in names)
        if round(1 - distance, 4) >= least:
            out[v] = (name, round(1 - distance, 4))
    return out


def strings(seed, n_names=150, n_values=80):
    rng = random.Random(seed)
    names = list({"".join(rng.choice("abcdeé 結") for _ in range(rng.randint(1, 14))).strip() or "x" for _ in range(n_names)})
    values = {"zzz", "a", "q" * 40, "aa"}
    while len(values) < n_values:
        v = list(rng.choice(names))
        for _ in range(rng.randint(0, 1 + len(v) // 2)):
            at = rng.randrange(len(v) + 1)
            v[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
        values.add("".join(v).strip() or "y")
    return sorted(values), names


@pytest.mark.parametrize("least", [0.9, 0.7, 0.5, 0.3, 0.05])
def test_equals_all_pairs(spark, least):
    values, names = strings(int(least * 100))
    frames = [materialise(spark.createDataFrame([(s,) for s in side], "text string")) for side in (values, names)]
    found, _ = similarity.nearest_names(*frames, least)
    assert {r.text: (r.name, round(1 - r.distance, 4)) for r in found.collect()} == plain(values, names, least)


def test_few_pairs_are_measured(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randint(8, 20))) for _ in range(1500)]
    values = ["brand " + n for n in names[:100]] + [n[:3] + n[4:] for n in names[100:300]]
    frames = [materialise(spark.createDataFrame([(s,) for s in sorted(set(side))], "text string")) for side in (values, names)]
    found, compared = similarity.nearest_names(*frames, 0.5)
    assert found.count() >= 290
    assert compared.count() < 0.02 * len(set(values)) * len(set(names))


def test_through_the_dictionary(spark):
    values, names = strings(77)
    items = [(f"id_{i}", n, i, []) for i, n in enumerate(names)]
    df = spark.createDataFrame([(v,) for v in [*values, values[0]]] + [(None,), ("",)], "v string")
    got = nz.similar_values(df, "v", items, 0.5).collect()
    want = plain([" ".join(v.split()) for v in values], [" ".join(n.split()) for n in names], 0.5)
    assert {" ".join(r.v.split()): (r.similar_name, r.similarity) for r in got} == want
    assert sum(r.v == values[0] for r in got) == 2 * (values[0] in want)


def test_any_name_will_do(spark):
    df = spark.createDataFrame([("xyz",)], "v string")
    items = [(f"id_{i}", f"name {i}", i, []) for i in range(100)]
    [row] = nz.similar_values(df, "v", items, 0.0).collect()
    assert row.similarity == 0.0 and row.similar_name == "name 0"


def test_gram_sizes():
    assert [similarity.gram_size(s, 30) for s in (0.9, 0.7, 0.6, 0.5, 0.4)] == [3, 3, 2, 2, 1]
    assert similarity.gram_size(0.5, 20_000) == 1
