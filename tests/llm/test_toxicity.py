import random

import numpy as np
import pytest

from rollbook.llm import toxicity as tx
from rollbook.llm.textkernel import as_bytes

STEMS = ["the", "ing", "tion", "re", "ha", "on"]


def corpus(words, n, seed):
    """Every fourth text holds a few words with one of two stems."""
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        own = words(rng, rng.randint(5, 200), STEMS).split()
        if i % 4 == 0:
            for _ in range(3):
                own.insert(rng.randrange(len(own) + 1), rng.choice(["zorg", "kwux"]) + rng.choice(["a", "el", "ing", "tion"]))
        texts.append(" ".join(own))
        labels.append(i % 4 == 0)
    return texts, np.array(labels)


def test_gradients():
    network = tx.Network()
    words, index, owner = tx._windows([b"some words in a row", b"other short text", b""])
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        odds = network.forward(network.inputs(words), index).astype(float)
        return float(np.sum(np.log1p(np.exp(odds)) - labels * odds))
    trace = {}
    odds = network.forward(network.inputs(words), index, trace)
    grads, d_inputs = network.backward(index, trace, (tx._sigmoid(odds) - labels).astype(np.float32))
    network.dense = {k: v.astype(np.float64) for k, v in network.dense.items()}
    rng = np.random.default_rng(0)
    for name, grad in grads.items():
        value = network.dense[name]
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in value.shape)
            value[at] += 1e-4
            up = loss()
            value[at] -= 2e-4
            down = loss()
            value[at] += 1e-4
            assert (up - down) / 2e-4 == pytest.approx(float(np.asarray(grad)[at]), abs=2e-3), name
    assert d_inputs.shape == (len(words.word), tx.EMBED)


@pytest.fixture(scope="module")
def network(words):
    texts, labels = corpus(words, 600, 1)
    return tx.train(as_bytes(texts), labels)


def test_held_out_accuracy(network, words):
    texts, labels = corpus(words, 300, 2)
    scores = network.scores(as_bytes(texts))
    assert ((scores >= 0.7) == labels).mean() > 0.97 and scores.min() >= 0 and scores.max() <= 1


def test_every_window_counts(network, words):
    rng = random.Random(8)
    clean = words(rng, 3000, STEMS)
    bad = "zorgel kwuxing zorga"
    for place in (0, 0.37, 1):
        cut = clean.find(" ", int(place * (len(clean) - 10)))
        text = clean[:cut] + " " + bad + " " + clean[cut:] if place < 1 else clean + " " + bad
        assert network.scores([text.encode()])[0] >= 0.7
    assert network.scores([clean.encode()])[0] < 0.7


def test_long_texts_in_slices(network, words, monkeypatch):
    rng = random.Random(9)
    text = (words(rng, 4000, STEMS) + " zorgel kwuxing zorga " + words(rng, 500, STEMS)).encode()
    whole = network.scores([text, b"x"])
    monkeypatch.setattr(tx, "STRIP_BYTES", 3000)
    assert (network.scores([text, b"x"]) >= 0.7).tolist() == (whole >= 0.7).tolist() == [True, False]


def test_in_spark(spark, documents, words):
    texts, labels = corpus(words, 240, 3)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(900, None, "en", "s"), (901, "", "en", "s"), (902, texts[0], "en", "s"), (0, texts[0], "en", "s")]
    docs = documents(rows)
    marks = spark.createDataFrame([(i, bool(y), "k") for i, y in enumerate(labels)] + [(900, True, "k"), (5, None, "k")], "doc_id long, toxic boolean, key string")
    first = tx.fit(docs, marks)
    again = tx.fit(docs.repartition(7), marks.repartition(3))
    assert all(np.array_equal(first.dense[k], again.dense[k]) for k in first.dense)
    got = tx.score(docs, first, name="rating").collect()
    assert len(got) == len(rows) and all(0 <= r.rating <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.rating)
    assert max(by[0] | by[902]) - min(by[0] | by[902]) < 1e-5 and max(by[900] | by[901]) - min(by[900] | by[901]) < 1e-5
    assert len(tx.training_sample(docs, marks, toxic=10, clean=20)) < 60 < len(tx.training_sample(docs, marks))
    assert tx.fit(docs, marks.limit(0)).scores([b"x"])[0] < 0.01
    assert tx.score(documents([]), first, name="rating").count() == 0


def test_one_class_only(documents):
    assert tx.train([b"a b", b"c"], np.array([False, False])).scores([b"a b", b""]).max() < 0.01
    assert tx.train([], np.array([], dtype=bool)).scores([b"x"])[0] == pytest.approx(0.001, abs=0.001)
