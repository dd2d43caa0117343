"""Spelling variants: frequent words with the near words that look like slips of them.

Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z in lower case, from ``letters`` letters and
``least`` occurrences on.  Two words are near if one letter is inserted, deleted or replaced.

A word is a vector of letter counts.  One edit changes it by a squared distance of 1 (lengths differ by
one) or 2 (equal lengths), so near words lie within 2.  Distances come from Gram matrices, products of blocks of vectors: words of one
length against words of the same and of the next length.  Comparing all words of these lengths would be
quadratic in the vocabulary, so blocks are finer: the alphabet is dealt into a few sets of letters, and as
one edit touches two letters at most, near words agree in the counts of all sets but two.
Blocks are words that agree in such a choice of sets; a pair is taken in the first block that it
shares.  Blocks of many words are cut into pieces of bounded size which meet
piece by piece.  Pairs within the distance are verified letter by letter, and leave a
task as sums per word: how many near words, and the best of them.

Each word's form is its near word of most occurrences, if these are ``TIMES`` its own or more.  Forms grow by that factor,
so chains are short; the root is the last of the chain.

Cases: a NULL text has no words; repeated rows count as often as they stand; a row with a NULL id loses
no letters to ``slips``; ties go to the smaller word in code-point order; very long words are compared like others, in
smaller pieces; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.operators.joins import lookup_join
from rollbook.session import materialise

LETTERS = 7
LEAST = 2
TIMES = 10
# Sets of letters: four up to so many words, one more for each eightfold, so that blocks stay small.
FOUR_PARTS = 1 << 20
# Pieces of large blocks, and runs of small ones.
PIECE_WORDS = 2048
PIECE_BYTES = 4 << 20
RUN_WORDS = 1024
STRIP_BYTES = 16 << 20
FLUSH_WORDS = 1 << 17
SLIP = 31

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_CAPITALS = {c: c + 32 for c in range(65, 91)}
ALPHABET = [*range(97, 123), *range(0xC0, 0x100)]
_COLUMN = np.zeros(256, dtype=np.int64)
_COLUMN[ALPHABET] = np.arange(len(ALPHABET))

Alter = Callable[[int, str], str]


def slips(doc_id: int | None, run: str) -> str:
    """A run with one letter missing in one of ``SLIP`` cases, told by a checksum of document and run."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % SLIP else run[:at] + run[at + 1:]


def _counted(frames: Iterator[pd.DataFrame], letters: int, alter: Alter | None) -> Iterator[pd.DataFrame]:
    """How often words occur, in parts."""
    total: Counter[str] = Counter()

    def drain() -> pd.DataFrame:
        out = pd.DataFrame({"word": list(total.keys()), "n": list(total.values())})
        total.clear()
        return out

    for rows in frames:
        for doc_id, text in zip(rows["id"], rows["text"]):
            if text is None:
                continue
            known = None if pd.isna(doc_id) else int(doc_id)
            for run, n in Counter(RUN.findall(text.translate(_CAPITALS) if not text.isascii() else text.lower())).items():
                if len(run) >= letters:
                    word = alter(known, run) if alter else run
                    if len(word) >= letters:
                        total[word] += n
            if len(total) >= FLUSH_WORDS:
                yield drain()
    if total:
        yield drain()


def vocabulary(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", letters: int = LETTERS, least: int = LEAST, alter: Alter | None = None,
) -> DataFrame:
    """``(word, n)`` over all texts; ``alter`` may change a document's runs before they are counted."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    parts = rows.mapInPandas(lambda frames: _counted(frames, letters, alter), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# --- blocks -------------------------------------------------------------------------------


def parts_for(words: int) -> int:
    return 4 + max(0, -(-words // FOUR_PARTS) - 1).bit_length() // 3


def letter_sets(words: DataFrame, parts: int) -> np.ndarray:
    """The set each letter of the alphabet is in: letters dealt out by how many words they stand in, so that sets weigh alike."""
    counts = words.select(*[F.count_if(F.contains("word", F.lit(chr(c)))).alias(str(c)) for c in ALPHABET]).first()
    sets, weight = np.zeros(len(ALPHABET), dtype=np.int64), np.zeros(parts)
    for i in sorted(range(len(ALPHABET)), key=lambda i: (-counts[i], i)):
        sets[i] = weight.argmin()
        weight[sets[i]] += counts[i] + 1e-6
    return sets


def _matrix(words: np.ndarray | pd.Series) -> np.ndarray:
    """Words of one length as rows of bytes, a letter each."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    n = len(letters)
    cells = (np.arange(n)[:, None] * len(ALPHABET) + _COLUMN[letters]).ravel()
    return np.bincount(cells, minlength=n * len(ALPHABET)).reshape(n, -1)


def _choices(parts: int) -> list[tuple[int, ...]]:
    return list(combinations(range(parts), parts - 2))


def block_keys(counts: np.ndarray, sets: np.ndarray, parts: int) -> np.ndarray:
    """A column of keys per choice of sets: 64 bits of the counts of the letters in these sets."""
    odd = np.random.default_rng(11).integers(0, 1 << 63, (2, len(ALPHABET)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    spread = (counts.astype(np.uint64) + np.uint64(1)) * odd[0]
    spread = (spread ^ (spread >> np.uint64(29))) * odd[1]
    one = np.stack([(spread * (sets == k)).sum(axis=1, dtype=np.uint64) for k in range(parts)], axis=1)
    return np.stack([one[:, list(c)].sum(axis=1, dtype=np.uint64) + np.uint64(i) for i, c in enumerate(_choices(parts))], axis=1)


def _keyed(frames: Iterator[pd.DataFrame], sets: np.ndarray, parts: int) -> Iterator[pd.DataFrame]:
    """Each word with its block of every choice of sets."""
    for rows in frames:
        sizes = rows["word"].str.len().to_numpy()
        for length in np.unique(sizes):
            mine = rows[sizes == length]
            step = max(1, STRIP_BYTES // (int(length) + 64 * len(ALPHABET)))
            for at in range(0, len(mine), step):
                part = mine.iloc[at:at + step]
                keys = block_keys(letter_counts(_matrix(part["word"])), sets, parts)
                yield pd.DataFrame({"word": part["word"], "n": part["n"], "size": int(length), "keys": list(keys.view(np.int64))})


# --- pairs --------------------------------------------------------------------------------


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, whether words of equal length, or the second longer by one, differ by one edit."""
    width = a.shape[1]
    left = a != b[:, :width]
    if b.shape[1] == width:
        return left.sum(axis=1) == 1
    right = a != b[:, 1:]
    first = np.where(left.any(axis=1), left.argmax(axis=1), width)
    last = np.where(right.any(axis=1), width - 1 - right[:, ::-1].argmax(axis=1), -1)
    return last < first


def _first_choices(parts: int) -> np.ndarray:
    """Per set of sets that differ, as bits, the first choice without any of them; -1 for none."""
    choices = [sum(1 << k for k in c) for c in _choices(parts)]
    return np.array([next((i for i, c in enumerate(choices) if not c & bits), -1) for bits in range(1 << parts)])


class _Blocks:
    """Sums of near words over whole blocks, for one task."""

    def __init__(self, sets: np.ndarray, parts: int):
        self.bit = (1 << sets).astype(np.int64)
        self.first = _first_choices(parts)

    def _side(self, words: np.ndarray, at: np.ndarray, length: int) -> tuple:
        letters = _matrix(words[at])
        counts = letter_counts(letters)
        square = (counts * counts).sum(axis=1)[:, None]
        one = np.ones_like(square)
        # products up to the square of the length are exact; left times right is the distance below zero
        kind = np.float32 if length < 2048 else np.float64
        return at, letters, counts, np.hstack([2 * counts, -square, -one]).astype(kind), np.hstack([counts, one, square]).astype(kind).T

    def pairs(self, part: slice, columns: dict, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Near pairs of rows that are in one block, length by length against the same and the next."""
        piece, choice, inside = columns["piece"], columns["choice"], columns["i"] == columns["j"]
        size = columns["size"][part]
        before, last = None, -1
        for length in np.unique(size):
            at = part.start + np.flatnonzero(size == length)
            own = self._side(columns["word"], at, length)
            for a in ([own, before] if before is not None and last == length - 1 else [own]):
                i, j = np.divmod(np.flatnonzero(a[3] @ own[4] >= -2), len(at))
                x, y = a[0][i], at[j]
                keep = (group[x] == group[y]) & ((piece[x] != piece[y]) | inside[x])
                if a is own:
                    keep &= i < j
                i, j = i[keep], j[keep]
                keep = one_edit(a[1][i], own[1][j])
                i, j = i[keep], j[keep]
                differ = np.bitwise_or.reduce(np.where(a[2][i] != own[2][j], self.bit, 0), axis=1, initial=0)
                keep = self.first[differ] == choice[a[0][i]]
                yield a[0][i[keep]], at[j[keep]]
            before, last = own, length

    @staticmethod
    def sums(x: np.ndarray, y: np.ndarray, columns: dict) -> pd.DataFrame:
        own, other = np.concatenate([x, y]), np.concatenate([y, x])
        pairs = pd.DataFrame({"word": columns["word"][own], "form": columns["word"][other], "form_n": columns["n"][other]})
        pairs = pairs.sort_values(["word", "form_n", "form"], ascending=[True, False, True])
        best = pairs.drop_duplicates("word")
        return best.assign(n_near=pairs.groupby("word", sort=False).size().to_numpy())[["word", "form_n", "form", "n_near"]]

    def run(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Over rows sorted by (key, i, j): as many whole blocks at a time as make a run."""
        held = None
        for rows in frames:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            held = yield from self._runs(rows, False)
        if held is not None:
            yield from self._runs(held, True)

    def _runs(self, rows: pd.DataFrame, last: bool):
        columns = {c: rows[c].to_numpy() for c in rows.columns}
        new = np.any([columns[c][1:] != columns[c][:-1] for c in ("key", "i", "j")], axis=0)
        group = np.concatenate(([0], np.cumsum(new)))
        starts = np.concatenate(([0], np.flatnonzero(new) + 1, [len(rows)] if last else []))
        starts = starts.astype(np.int64)
        at, found = 0, []
        while at < len(starts) - 1:
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + RUN_WORDS, side="right")) - 1)
            if starts[to] - starts[at] > 1:
                found.extend(self.pairs(slice(int(starts[at]), int(starts[to])), columns, group))
            at = to
        if sum(len(x) for x, _ in found):
            yield self.sums(*(np.concatenate([f[k] for f in found]) for k in (0, 1)), columns)
        return rows.iloc[starts[at]:]


def near_words(words: DataFrame, parts: int | None = None, piece_words: int = PIECE_WORDS) -> DataFrame:
    """``(word, n_near, form_n, form)`` of the words that have near words: how many, and the one of most occurrences."""
    parts = parts or parts_for(words.count())
    sets = letter_sets(words, parts)
    keyed = words.select("word", "n").mapInPandas(
        lambda frames: _keyed(frames, sets, parts), "word string, n long, size int, keys array<long>")
    blocked = keyed.select(F.posexplode("keys").alias("choice", "key"), "word", "n", "size")
    fit = F.greatest(F.lit(1), F.least(F.lit(piece_words), F.lit(PIECE_BYTES) / (F.max("size") + 4 * len(ALPHABET))))
    large = materialise(
        blocked.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.ceil(F.count(F.lit(1)) / fit).cast("int").alias("pieces"))
        .filter("pieces > 1").select("key", "pieces"), "large_blocks")
    placed = lookup_join(blocked, large, ["key"], ["word"], [])
    pieces = F.coalesce("pieces", F.lit(1))
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("word"), pieces).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1))).select(
        "key", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "piece", "choice", "word", "n", "size")
    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    sums = ordered.mapInPandas(lambda frames: _Blocks(sets, parts).run(frames), "word string, form_n long, form string, n_near long")
    best = F.min(F.struct((-F.col("form_n")).alias("least"), F.col("form"))).alias("best")
    return sums.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.least")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` by doubling: each round goes on from where the last one came to."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        if moved.filter("went").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def variants(words: DataFrame, times: int = TIMES, parts: int | None = None) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for a stored vocabulary ``(word, n)``."""
    near = materialise(near_words(words, parts), "near")
    found = words.join(near, "word", "left")
    formed = F.col("form_n") >= F.lit(times) * F.col("n")
    found = materialise(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("form")).alias("form"),
        F.when(formed, F.col("form_n")).alias("form_n")), "variants")
    ends = roots(found.filter("form IS NOT NULL"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
