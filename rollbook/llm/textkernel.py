"""Word hashes of many texts at once, for use inside tasks.

Words are runs of bytes other than space and 0x09 to 0x0D.  A word's hash is 64
bits of a polynomial over its bytes, mixed with its length.  Texts are handled in
strips of bounded size; a very long text is cut at white space for hashing and
put together again, so memory follows the longest single word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

STRIP_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> np.ndarray:
    table = np.full(max(n, 1), _BASE, dtype=np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    space = np.ones(len(data) + 2, dtype=np.int8)
    space[1:-1] = SPACE[data]
    edges = np.flatnonzero(np.diff(space))
    return edges[0::2], edges[1::2]


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of one strip."""
    starts, ends = bounds(data)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts
    lengths = ends - starts
    body = data[~SPACE[data]]
    first = np.cumsum(lengths) - lengths
    position = np.arange(len(body)) - np.repeat(first, lengths)
    terms = (body.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[position]
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def _slices(text: bytes) -> Iterator[bytes]:
    """A text in slices that end at white space."""
    at = 0
    while len(text) - at > STRIP_BYTES:
        stop = at + STRIP_BYTES
        while stop < len(text) and not SPACE[text[stop]]:
            stop += 1
        yield text[at:stop]
        at = stop
    yield text[at:]


def word_hashes(texts: Sequence[bytes], lower: bool = True) -> Iterator[np.ndarray]:
    """For each text the hashes of its words in order, as 64-bit unsigned values."""
    def run(group: list[bytes]) -> Iterator[np.ndarray]:
        data = np.frombuffer(b" ".join(group), dtype=np.uint8)
        hashes, starts = _hashes(LOWER[data] if lower else data)
        offsets = np.cumsum([0] + [len(t) + 1 for t in group])
        cuts = np.searchsorted(starts, offsets)
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield hashes[a:b]

    group, held = [], 0
    for text in texts:
        if held + len(text) > STRIP_BYTES and group:
            yield from run(group)
            group, held = [], 0
        if len(text) > STRIP_BYTES:
            yield np.concatenate([h for part in _slices(text) for h in run([part])])
        else:
            group.append(text)
            held += len(text)
    if group:
        yield from run(group)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of a text in order; a shorter text has one, a text without words none."""
    if not len(words):
        return words
    n = min(n, len(words))
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        total = mix(total + words[i:len(words) - n + 1 + i] * np.uint64(2 * i + 3) + np.uint64(n))
    return total


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def as_bytes(texts: Sequence[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]
