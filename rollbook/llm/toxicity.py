"""Toxicity: a bidirectional gated recurrent network over words and their characters.

A word's input vector is the sum of its own hashed embedding and those of
its character 3-, 5- and 7-grams, scaled by the root of their number.  Two gated recurrent layers read a window of
words in both directions, attention pools their states, and one unit gives the
window's log-odds.  Windows overlap by half and cover the whole text; the
worst one decides.

The network is trained in numpy on the driver, on a bounded sample of labelled
rows.  A label belongs to a document, so a toxic document stands for its worst window,
chosen again before each epoch; a clean one for its worst and a random one.  Labels may be
wrong, so a toxic document is left out while its worst window looks clean.

Cases: a NULL text counts as empty; an empty text is one window without words and has
a score as well; NULL labels are not learned from; with one class only the
score is that class's share; repeated rows get scores equal up to rounding; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.textkernel import LOWER, STRIP_BYTES, SPACE, as_bytes, bounds, mix, powers

WINDOW = 40
STRIDE = 20
EMBED = 16
HIDDEN = 12
WORD_BITS = 15
GRAM_BITS = 16
GRAMS = (3, 5, 7)
BATCH_WINDOWS = 2048
INPUT_WORDS = 1 << 13
# The sample learned from: at most about so many rows of each label, none longer than so many bytes.
TRAIN_TOXIC = 1_200
TRAIN_CLEAN = 2_400
TRAIN_BYTES = 1 << 14
EVIDENCE_TEXTS = 128
EPOCHS = 7
BATCH = 128
RATE = 0.01
# Texts that must hold a feature for half its weight.
TRUST = 5
# A toxic text is learned from while its worst window is beyond this share of the clean ones', or has these log-odds.
BEYOND = 0.98
LEAST_ODDS = -1.0
SEED = 7


@dataclass
class Words:
    """Distinct words: hashed ids of each word and, word after word, of its character grams."""

    key: np.ndarray  # the whole hash
    word: np.ndarray
    begin: np.ndarray  # where each word's grams begin, and the end
    gram: np.ndarray
    weight: np.ndarray  # one over the root of the number of grams of that length in the word

    def pick(self, rows: np.ndarray) -> Words:
        counts = np.diff(self.begin)[rows]
        at, _ = _ranges(self.begin[rows], counts)
        return Words(self.key[rows], self.word[rows], np.append(0, np.cumsum(counts)), self.gram[at], self.weight[at])

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.word)), np.diff(self.begin))


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(first)), count)
    return np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count), owner


def _distinct_words(data: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Distinct words of an array of bytes, each word's number among them, and the words' starts."""
    data = np.concatenate((np.full(1, 32, np.uint8), LOWER[data], np.full(max(GRAMS), 32, np.uint8)))
    starts, ends = bounds(data)
    if not len(starts):
        empty = np.empty(0, dtype=np.int64)
        return Words(empty.view(np.uint64), empty, np.zeros(1, np.int64), empty.astype(np.int32), empty.astype(np.float32)), empty, empty
    lengths = ends - starts
    body = data[~SPACE[data]].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(lengths) - lengths
    position = np.arange(len(body)) - np.repeat(first, lengths)
    hashes = mix(np.add.reduceat(body * powers(int(lengths.max()))[position], first))
    keys, sample, number = np.unique(hashes, return_index=True, return_inverse=True)
    begin, size = starts[sample], lengths[sample]
    spaced = np.where(SPACE[data], np.uint8(32), data).astype(np.uint64)
    gram, owner, weight = [], [], []
    for n in GRAMS:
        count = np.maximum(size - n + 3, 0)  # from the space before to the space after; one at least of three characters
        at, of = _ranges(begin - 1, count)
        value = np.full(len(at), n, dtype=np.uint64)
        for i in range(n):
            value = value * np.uint64(0x100000001B3) + spaced[at + i]
        gram.append((mix(value) >> np.uint64(64 - GRAM_BITS)).astype(np.int32))
        owner.append(of)
        weight.append((1 / np.sqrt(np.maximum(count, 1))).astype(np.float32)[of])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(keys))
    word = (keys >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    return Words(keys, word, np.append(0, np.cumsum(counts)), np.concatenate(gram)[order], np.concatenate(weight)[order]), number, starts - 1


def _overlapping(text: bytes) -> Iterator[bytes]:
    """A long text in slices at white space that share a window of words."""
    at = 0
    while len(text) - at > STRIP_BYTES:
        stop = at + STRIP_BYTES
        while stop < len(text) and not SPACE[text[stop]]:
            stop += 1
        yield text[at:stop]
        starts, _ = bounds(np.frombuffer(text[at:stop], dtype=np.uint8))
        at = at + int(starts[-WINDOW]) if len(starts) > WINDOW else stop
    yield text[at:]


def _strips(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    numbers, strip, held = [], [], 0
    for number, text in enumerate(texts):
        for part in _overlapping(text):
            numbers.append(number)
            strip.append(part)
            held += len(part) + 1
            if held >= STRIP_BYTES:
                yield numbers, strip
                numbers, strip, held = [], [], 0
    if strip:
        yield numbers, strip


def _windows(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray]:
    """Distinct words of a strip, all windows over it (-1 pads), and each window's text."""
    words, number, starts = _distinct_words(np.frombuffer(b" ".join(texts), dtype=np.uint8))
    cuts = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    sizes = np.diff(cuts)
    count = 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
    step, owner = _ranges(np.zeros(len(texts), dtype=np.int64), count)
    begin = cuts[:-1][owner] + step * STRIDE
    index = begin[:, None] + np.arange(WINDOW)
    inside = index < cuts[1:][owner][:, None]
    padded = np.append(number, -1)
    return words, np.where(inside, padded[np.minimum(index, len(number))], -1), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, forward and backward pass."""

    def __init__(self, seed: int = SEED):
        draw = np.random.default_rng(seed)

        def normal(*shape, scale):
            return draw.normal(0, scale, shape).astype(np.float32)

        self.embedding = {"word": normal(1 << WORD_BITS, EMBED, scale=0.1), "gram": normal(1 << GRAM_BITS, EMBED, scale=0.1)}
        self.dense = {"attend": normal(2 * HIDDEN, HIDDEN, scale=0.3), "attend_bias": np.zeros(HIDDEN, np.float32),
                      "score": normal(HIDDEN, scale=0.3), "out": normal(2 * HIDDEN, scale=0.3), "out_bias": np.zeros(1, np.float32)}
        for side in ("ahead", "back"):
            self.dense |= {f"{side}_in": normal(EMBED, 3 * HIDDEN, scale=0.3), f"{side}_in_bias": np.zeros(3 * HIDDEN, np.float32),
                           f"{side}_state": normal(HIDDEN, 3 * HIDDEN, scale=0.25), f"{side}_state_bias": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, words: Words) -> np.ndarray:
        """The input vector of each word."""
        total = self.embedding["word"][words.word].copy()
        for first in range(0, len(total), INPUT_WORDS):
            last = min(first + INPUT_WORDS, len(total))
            part = slice(words.begin[first], words.begin[last])
            rows = self.embedding["gram"][words.gram[part]]
            rows *= words.weight[part, None]
            total[first:last] += np.add.reduceat(rows, words.begin[first:last] - words.begin[first], axis=0)
        return total

    def _run(self, side: str, projected: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        state, bias = self.dense[f"{side}_state"], self.dense[f"{side}_state_bias"]
        n, steps = index.shape
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps) if side == "ahead" else range(steps - 1, -1, -1):
            x = projected[index[:, t]]
            inner = h @ state + bias
            gates = _sigmoid(x[:, :2 * HIDDEN] + inner[:, :2 * HIDDEN])
            update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
            fresh = np.tanh(x[:, 2 * HIDDEN:] + reset * inner[:, 2 * HIDDEN:])
            live = mask[:, t, None]
            if keep is not None:
                keep.append((t, h, update, reset, fresh, inner[:, 2 * HIDDEN:]))
            h = np.where(live, fresh + update * (h - fresh), h)
            out[t] = h
        return out

    def forward(self, inputs: np.ndarray, index: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Log-odds of each window; ``index`` holds rows of ``inputs``, -1 where there is no word."""
        d = self.dense
        mask = index >= 0
        padded = np.concatenate([inputs, np.zeros((1, EMBED), np.float32)])
        sides, kept = [], {}
        for side in ("ahead", "back"):
            kept[side] = [] if trace is not None else None
            projected = padded @ d[f"{side}_in"] + d[f"{side}_in_bias"]
            sides.append(self._run(side, projected, index, mask, kept[side]))
        states = np.concatenate(sides, axis=2)  # step, window, both directions
        hidden = np.tanh(states @ d["attend"] + d["attend_bias"])
        logits = np.where(mask.T, hidden @ d["score"], np.float32(-1e9))
        weights = np.exp(logits - logits.max(axis=0)) * mask.T
        weights /= np.maximum(weights.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", weights, states)
        if trace is not None:
            trace |= {"mask": mask, "padded": padded, "kept": kept, "states": states, "hidden": hidden, "weights": weights, "pooled": pooled}
        return pooled @ d["out"] + d["out_bias"][0]

    def backward(self, index: np.ndarray, trace: dict, slope: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters and of the input vectors, from the slope of the loss at the log-odds."""
        d, g = self.dense, {}
        states, hidden, weights, pooled, mask = (trace[k] for k in ("states", "hidden", "weights", "pooled", "mask"))
        g["out"], g["out_bias"] = pooled.T @ slope, slope.sum(keepdims=True)
        d_pooled = slope[:, None] * d["out"]
        d_states = weights[:, :, None] * d_pooled
        d_weights = np.einsum("nh,tnh->tn", d_pooled, states)
        d_logits = weights * (d_weights - (weights * d_weights).sum(axis=0))
        g["score"] = np.einsum("tn,tnh->h", d_logits, hidden)
        d_hidden = d_logits[:, :, None] * d["score"] * (1 - hidden**2)
        g["attend"] = np.einsum("tni,tnj->ij", states, d_hidden)
        g["attend_bias"] = d_hidden.sum(axis=(0, 1))
        d_states += d_hidden @ d["attend"].T
        d_inputs = np.zeros_like(trace["padded"])
        for k, side in enumerate(("ahead", "back")):
            own = d_states[:, :, k * HIDDEN:(k + 1) * HIDDEN]
            state = d[f"{side}_state"]
            g_state, g_bias = np.zeros_like(state), np.zeros(3 * HIDDEN, np.float32)
            d_projected = np.zeros((len(trace["padded"]), 3 * HIDDEN), np.float32)
            carried = np.zeros((len(index), HIDDEN), np.float32)
            for t, h, update, reset, fresh, inner in reversed(trace["kept"][side]):
                live = mask[:, t, None]
                total = own[t] + carried
                active = np.where(live, total, 0)
                d_fresh = active * (1 - update) * (1 - fresh**2)
                d_update = active * (h - fresh) * update * (1 - update)
                d_reset = d_fresh * inner * reset * (1 - reset)
                d_inner = np.concatenate([d_update, d_reset, d_fresh * reset], axis=1)
                np.add.at(d_projected, index[:, t], np.concatenate([d_update, d_reset, d_fresh], axis=1))
                g_state += h.T @ d_inner
                g_bias += d_inner.sum(axis=0)
                carried = np.where(live, active * update, total) + d_inner @ state.T
            d_projected[-1] = 0
            g[f"{side}_state"], g[f"{side}_state_bias"] = g_state, g_bias
            g[f"{side}_in"], g[f"{side}_in_bias"] = trace["padded"].T @ d_projected, d_projected.sum(axis=0)
            d_inputs += d_projected @ d[f"{side}_in"].T
        return g, d_inputs[:-1]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The worst window's probability of each text."""
        worst = np.full(len(texts), -np.inf)
        for numbers, strip in _strips(texts):
            words, index, owner = _windows(strip)
            inputs = self.inputs(words)
            for at in range(0, len(index), BATCH_WINDOWS):
                part = slice(at, at + BATCH_WINDOWS)
                np.maximum.at(worst, np.asarray(numbers)[owner[part]], self.forward(inputs, index[part]))
        return _sigmoid(worst)


def _evidence(words: Words, index: np.ndarray, owner: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each hashed word and gram, from the number of toxic and clean texts that hold it; rare ones count less."""
    counts = np.diff(words.begin)
    held = {bits: np.zeros((2, 1 << bits)) for bits in (WORD_BITS, GRAM_BITS)}
    for first in range(0, len(toxic), EVIDENCE_TEXTS):
        part = (owner >= first) & (owner < first + EVIDENCE_TEXTS)
        number = index[part]
        text = np.repeat(owner[part] - first, WINDOW)[number.ravel() >= 0]
        number = number.ravel()[number.ravel() >= 0]
        pairs = np.unique(text * len(words.word) + number)
        text, number = pairs // len(words.word), pairs % len(words.word)
        at, of = _ranges(words.begin[number], counts[number])
        for ids, texts, bits in ((words.word[number], text, WORD_BITS), (words.gram[at], text[of], GRAM_BITS)):
            once = np.unique(texts << bits | ids)
            marks, ids = toxic[first + (once >> bits)], once & ((1 << bits) - 1)
            for m in (0, 1):
                held[bits][m] += np.bincount(ids[marks == m], minlength=1 << bits)
    share = toxic.mean()
    out = []
    for good, bad in (held[WORD_BITS], held[GRAM_BITS]):
        odds = np.log((bad + 4 * share) / share) - np.log((good + 4 * (1 - share)) / (1 - share))
        out.append((odds * (bad + good) / (bad + good + TRUST)).astype(np.float32))
    return out[0], out[1]


def _joined_windows(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray]:
    """The windows of many texts over common distinct words, read strip by strip."""
    parts, indices, owners = [], [], []
    for numbers, strip in _strips(texts):
        words, index, owner = _windows(strip)
        parts.append(words)
        indices.append(index.astype(np.int32))
        owners.append(np.asarray(numbers)[owner])
    keys, first, number = np.unique(np.concatenate([p.key for p in parts]), return_index=True, return_inverse=True)
    # words stand in the order of their first strip
    place = np.empty(len(keys), dtype=np.int32)
    place[np.argsort(first, kind="stable")] = np.arange(len(keys))
    number, start, own = place[number], 0, []
    for part, index in zip(parts, indices):
        index[index >= 0] = number[start + index[index >= 0]]
        own.append(part.pick(np.sort(first[(first >= start) & (first < start + len(part.key))]) - start))
        start += len(part.key)
    counts = np.concatenate([np.diff(p.begin) for p in own])
    whole = Words(*(np.concatenate([getattr(p, name) for p in own]) for name in ("key", "word")), np.append(0, np.cumsum(counts)),
                  *(np.concatenate([getattr(p, name) for p in own]) for name in ("gram", "weight")))
    return whole, np.concatenate(indices), np.concatenate(owners)


def train(texts: list[bytes], toxic: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network for the given texts and labels."""
    network = Network(seed)
    toxic = np.asarray(toxic, dtype=bool)
    if not len(texts) or toxic.all() or not toxic.any():
        share = float(toxic.mean()) if len(texts) else 0.0
        network.dense["out"][:] = 0
        network.dense["out_bias"][0] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return network
    words, index, owner = _joined_windows(texts)
    word_odds, gram_odds = _evidence(words, index, owner, toxic)
    network.embedding["word"][:, 0] = np.clip(word_odds, -3, 3)
    network.embedding["gram"][:, 0] = np.clip(gram_odds, -3, 3)
    strongest = np.maximum(word_odds[words.word], np.maximum.reduceat(gram_odds[words.gram], words.begin[:-1])) if len(words.word) else word_odds[:0]
    seen = np.append(strongest, -9.0)[index].max(axis=1)
    draw = np.random.default_rng(seed)
    fast = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.dense.items()}
    slow = {k: np.full(len(v), 1e-3, np.float32) for k, v in network.embedding.items()}
    step = 0
    for epoch in range(epochs):
        if epoch:
            inputs = network.inputs(words)
            seen = np.concatenate([network.forward(inputs, index[a:a + BATCH_WINDOWS]) for a in range(0, len(index), BATCH_WINDOWS)])
        order = np.lexsort((draw.random(len(owner)), seen, owner))
        last = np.flatnonzero(np.append(owner[order][1:] != owner[order][:-1], True))
        worst = order[last]
        bar = np.quantile(seen[worst][~toxic[owner[worst]]], BEYOND) if epoch < 2 else LEAST_ODDS
        worst = worst[~toxic[owner[worst]] | (seen[worst] > bar)]
        spare = draw.integers(0, len(owner), (~toxic).sum() * 2)
        spare = spare[~toxic[owner[spare]]]
        chosen = draw.permutation(np.concatenate([worst, spare]))
        for at in range(0, len(chosen), BATCH):
            batch = chosen[at:at + BATCH]
            used, local = np.unique(index[batch], return_inverse=True)
            local = local.reshape(len(batch), WINDOW) - (used[0] == -1)
            part = words.pick(used[used >= 0])
            trace: dict = {}
            odds = network.forward(network.inputs(part), local, trace)
            slope = ((_sigmoid(odds) - toxic[owner[batch]]) / len(batch)).astype(np.float32)
            grads, d_inputs = network.backward(local, trace, slope)
            step += 1
            for k, value in grads.items():
                m, v = fast[k]
                m += 0.1 * (value - m)
                v += 0.01 * (value**2 - v)
                network.dense[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            for k, ids, rows in (("word", part.word, d_inputs), ("gram", part.gram, d_inputs[part.owner] * part.weight[:, None])):
                rare, at_row = np.unique(ids, return_inverse=True)
                total = np.zeros((len(rare), EMBED), np.float32)
                np.add.at(total, at_row, rows)
                slow[k][rare] += (total**2).mean(axis=1)
                network.embedding[k][rare] -= 0.05 * total / np.sqrt(slow[k][rare])[:, None]
    return network


def training_sample(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN,
) -> pd.DataFrame:
    """``(text, toxic)``: a bounded share of each label's documents, chosen by a hash of the id.

    ``labels``: id and ``toxic`` (boolean); an id with several labels counts as toxic.  Ids are chosen before
    any text is read, so the chosen ones, no more than the bound asks for, are sent to the texts.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select(id_column).distinct(), id_column, "left_semi")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic"), toxic / max(counts.get(True, 1), 1)).otherwise(clean / max(counts.get(False, 1), 1))
    draw = F.pmod(F.xxhash64(id_column, F.lit("sample")), F.lit(1_000_000)) / 1e6
    chosen = known.filter(draw < share).limit(2 * (toxic + clean))
    texts = docs.select(id_column, F.col(text_column).cast("string").alias("text")).filter(F.octet_length("text") <= TRAIN_BYTES)
    picked = texts.join(F.broadcast(chosen), id_column).select("text", "toxic").dropDuplicates().limit(2 * (toxic + clean)).toPandas()
    return picked.sort_values(["text", "toxic"], kind="stable", ignore_index=True)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Network:
    """A network from the labelled ones among the given documents."""
    sample = training_sample(docs, labels, id_column, text_column)
    return train(as_bytes(sample["text"]), sample["toxic"].to_numpy(dtype=bool))


def score(docs: DataFrame, network: Network, text_column: str = "text", name: str = "score") -> DataFrame:
    """The documents with the probability of being toxic."""
    held = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.round(held.value.scores(as_bytes(texts)).astype(np.float64), 6))

    return docs.withColumn(name, rate(F.col(text_column).cast("string")))
