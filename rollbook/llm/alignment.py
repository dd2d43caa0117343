"""Tokens of two tokenizers laid over each other.

Every text is tokenised whole by both, once.  Where a token of each begins with a space at the same byte, what
lies before ends at the same byte too: there the text is cut.  Between two such anchors
lies a window, a pair of id tuples, and windows repeat: a task aligns each pair of tuples once, those new in some texts
together, and keeps what it found (groups, links) by the tuples.  Inside a window the byte ends of both sides give the groups
(ends that both have) and the links (pairs whose byte ranges overlap).

Texts are gathered in blocks of bounded size; few of them are Python strings at a time.  A block carries its windows by number, compressed, the links of each of its
distinct windows and how often each distinct id pair is linked.  Counts of pairs are summed over all
blocks, each pair's count goes back to the blocks that hold it by a join, and there each
window, then each text, adds up its links.

Cases: a NULL or empty text, or one whose bytes the tokenizers do not give back, has no tokens: zeros and an empty string;
special tokens inside texts are plain text; very long texts are tokenised in parts that end where both cut anyway;
repeated rows are texts of their own, and their links count; a NULL id stays NULL;
an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.packing import COMMON, RANKS, TOKENIZER, _encoders, _place
from rollbook.session import materialise

BYTE_LEVEL = TOKENIZER
PIECES = "piece_bpe_32k.model"
BLOCK_BYTES = 4 << 20
PART_CHARS = 1 << 18
MEMO_WINDOWS = 1 << 18
_ID_BITS = 20
# Both tokenizers cut between a letter and a space before a letter.
SEAM = re.compile(r"[a-z](?= [a-z])")
SPACE_MARK = "▁"


def _byte_letters() -> dict[str, int]:
    """The letter each byte is written as in byte-level vocabularies: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The bytes of each id: their number, and whether they begin with a space."""

    def __init__(self, tokens: Sequence[bytes]):
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.spaced = np.array([t[:1] == b" " for t in tokens])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, one after the other."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(sizes.sum())].tobytes()


class Tokenizers:
    """Both tokenizers.  ``encode`` gives the ids of a text's parts by each, the text with a space in front."""

    def __init__(self, first: str, second: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(_place(first))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=_place(second))
        self.fast = _encoders(first, RANKS)[0] if first == TOKENIZER else None
        letters = _byte_letters()
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.of_a = Vocabulary([bytes(letters[c] for c in n) if all(c in letters for c in n) else n.encode() for n in names])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.of_b = Vocabulary([
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)])
        # a piece with a space after another character would reach over a cut before a space
        self.cuts = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)

    def _parts(self, text: str) -> Iterator[str]:
        """A text in parts, each but the first without the space it began with."""
        at = 0
        while self.cuts and len(text) - at > PART_CHARS:
            seam = SEAM.search(text, at + PART_CHARS)
            if seam is None:
                break
            yield text[at:seam.end()]
            at = seam.end() + 1
        yield text[at:]

    def _first(self, part: str) -> np.ndarray:
        """Ids by the first tokenizer, of texts in common characters through an equal, faster implementation of its vocabulary."""
        if self.fast is not None and COMMON.fullmatch(part):
            return self.fast.encode_to_numpy(" " + part, allowed_special=set(), disallowed_special=()).astype(np.uint32, copy=False)
        return np.array(self.a.encode(" " + part, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per text the ids of both; empty where the bytes of their tokens are not the text's."""
        parts = [list(self._parts(t)) for t in texts]
        b = self.b.encode([p for own in parts for p in own], num_threads=1)
        at = 0
        for text, own in zip(texts, parts):
            x = np.concatenate([self._first(p) for p in own])
            y = np.concatenate([np.array(ids, dtype=np.uint32) for ids in b[at:at + len(own)]])
            at += len(own)
            whole = (" " + text).encode("utf-8", "surrogatepass")
            right = text and all(v.joined(ids) == whole for v, ids in ((self.of_a, x), (self.of_b, y)))
            yield (x, y) if right else (_NO_IDS, _NO_IDS)


_NO_IDS = np.empty(0, dtype=np.uint32)
# No id of either.
_BETWEEN = np.uint32(0xFFFFFFFF)


@lru_cache(maxsize=2)
def tokenizers(first: str = BYTE_LEVEL, second: str = PIECES) -> Tokenizers:
    return Tokenizers(first, second)


def anchors(a: np.ndarray, b: np.ndarray, of_a: Vocabulary, of_b: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers on both sides where windows begin, the ends of the text included."""
    end_a, end_b = np.cumsum(of_a.sizes[a]), np.cumsum(of_b.sizes[b])
    start_a, start_b = end_a - of_a.sizes[a], end_b - of_b.sizes[b]
    at_a, at_b = np.flatnonzero(of_a.spaced[a]), np.flatnonzero(of_b.spaced[b])
    _, i, j = np.intersect1d(start_a[at_a], start_b[at_b], assume_unique=True, return_indices=True)
    i, j = at_a[i], at_b[j]
    if not len(i) or i[0] or j[0]:
        i, j = np.concatenate(([0], i)), np.concatenate(([0], j))
    return np.append(i, len(a)), np.append(j, len(b))


class GroupText:
    """Writes groups of id tuples: each id with the mark that follows it comes from a table."""

    def __init__(self, ids: int):
        self.ids = ids
        self.written = [b"%d%c" % (i, mark) for mark in b",|;\n" for i in range(ids)]

    def __call__(self, ids: np.ndarray, marks: np.ndarray) -> bytes:
        return b"".join(map(self.written.__getitem__, (marks * self.ids + ids).tolist()))


def align(
    a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, of_a: Vocabulary, of_b: Vocabulary, write: GroupText,
) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Windows laid end to end, with the number of ids of each on both sides: per window its groups as text and their number, its
    number of linked id pairs, and these pairs.

    Both sides of a window have the same bytes, so that byte ends agree over all windows.  Between two neighbouring ends
    of either side just one token of each lies: a link.
    """
    a, b = a.astype(np.int64), b.astype(np.int64)
    end_a, end_b = np.cumsum(of_a.sizes[a]), np.cumsum(of_b.sizes[b])
    ends = np.union1d(end_a, end_b)
    i, j = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    links = a[i] << _ID_BITS | b[j]
    shared = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
    close = end_a[np.cumsum(sizes_a) - 1]  # where windows end
    groups = np.diff(np.searchsorted(shared, close, side="right"), prepend=0)
    link_sizes = np.diff(np.searchsorted(ends, close, side="right"), prepend=0)
    # ids in the order they are written: of each group those of a, then those of b
    key = np.concatenate([2 * group_a, 2 * group_b + 1])
    order = np.argsort(key, kind="stable")
    key, ids = key[order], np.concatenate([a, b])[order]
    follows = np.append(key[1:], key[-1] + 2)
    marks = np.where(follows == key, 0, np.where(key % 2 == 0, 1, 2))
    marks[np.cumsum(sizes_a + sizes_b) - 1] = 3
    return write(ids, marks).split(b"\n")[:-1], groups, link_sizes, links


class Windows:
    """Distinct windows by their id tuples, with what aligning them gave.

    New windows get their numbers at once; ``settle`` aligns all that are new together.
    """

    def __init__(self, both: Tokenizers):
        self.both = both
        self.write = GroupText(max(len(both.of_a.tokens), len(both.of_b.tokens)))
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.new: list[bytes] = []
        self.texts: list[bytes] = []
        self.groups = self.link_sizes = self.links = np.empty(0, dtype=np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """The windows of a text in order."""
        if not len(a):
            return []
        i, j = anchors(a, b, self.both.of_a, self.both.of_b)
        # both sides in one row of numbers: of each window the ids of a, a mark, those of b
        window_a, window_b = np.repeat(np.arange(len(i) - 1), np.diff(i)), np.repeat(np.arange(len(j) - 1), np.diff(j))
        both = np.full(len(a) + len(b) + len(i) - 1, _BETWEEN, dtype=np.uint32)
        both[np.arange(len(a)) + window_a + j[window_a]] = a
        both[np.arange(len(b)) + window_b + i[window_b + 1] + 1] = b
        raw, cuts = both.tobytes(), (4 * (i + j + np.arange(len(i)))).tolist()
        keys = [raw[p:q] for p, q in zip(cuts, cuts[1:])]
        numbers = self.numbers
        out = list(map(numbers.get, keys))
        if None in out:
            for at, key in enumerate(keys):
                if out[at] is None:
                    out[at] = number = numbers.setdefault(key, len(numbers))
                    if number == len(self.texts) + len(self.new):
                        self.new.append(key)
        return out

    def settle(self) -> None:
        if not self.new:
            return
        ids = np.frombuffer(b"".join(self.new), np.uint32)
        ends = np.cumsum([len(key) // 4 for key in self.new])
        between = np.flatnonzero(ids == _BETWEEN)
        sizes_a, sizes_b = between - np.append(0, ends[:-1]), ends - between - 1
        of_a = np.repeat(np.tile([True, False, False], len(ends)), np.stack([sizes_a, np.ones_like(ends), sizes_b], axis=1).ravel())
        a, b = ids[of_a], ids[~of_a & (ids != _BETWEEN)]
        texts, *found = align(a, b, sizes_a, sizes_b, self.both.of_a, self.both.of_b, self.write)
        self.texts += texts
        self.groups, self.link_sizes, self.links = (
            np.concatenate([old, new]) for old, new in zip((self.groups, self.link_sizes, self.links), found))
        self.new = []

    def links_of(self, windows: np.ndarray) -> np.ndarray:
        """The linked id pairs of the windows, one after the other."""
        sizes = self.link_sizes[windows]
        first = (np.cumsum(self.link_sizes) - self.link_sizes)[windows]
        before = np.cumsum(sizes) - sizes
        return self.links[np.repeat(first - before, sizes) + np.arange(sizes.sum())]


# --- blocks -------------------------------------------------------------------------------

_BLOCK = (
    "block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>,"
    " sizes binary, windows binary, link_sizes binary, links binary, pairs array<long>, times array<long>"
)


class _Block:
    """Texts gathered until they make a block."""

    def __init__(self, windows: Windows):
        self.windows = windows
        self.rows: list[tuple] = []
        self.seq: list[int] = []
        self.bytes = 0

    def add(self, ids: Sequence[int | None], sizes: Sequence[int], encoded: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        """Texts that go into the block together."""
        rows = [(doc_id, len(a), len(b), self.windows.of(a, b)) for doc_id, (a, b) in zip(ids, encoded)]
        self.windows.settle()
        text = self.windows.texts.__getitem__
        for doc_id, n_a, n_b, own in rows:
            digest = hashlib.sha256(b";".join(map(text, own))).hexdigest() if own else ""
            self.rows.append((doc_id, n_a, n_b, len(own), digest))
            self.seq.extend(own)
        self.bytes += sum(sizes)

    def drain(self, block: int) -> pa.RecordBatch:
        distinct, seq, times = np.unique(np.array(self.seq, dtype=np.int64), return_inverse=True, return_counts=True)
        link_sizes = self.windows.link_sizes[distinct]
        pairs, links = np.unique(self.windows.links_of(distinct), return_inverse=True)
        often = np.bincount(links, weights=np.repeat(times, link_sizes), minlength=len(pairs)).astype(np.int64)
        ids, n_a, n_b, sizes, digests = zip(*self.rows)
        sizes = np.array(sizes, dtype=np.int64)
        groups = self.windows.groups[distinct]
        longs = {"ids": ids, "n_a": n_a, "n_b": n_b, "n_groups": _sums(groups[seq], sizes), "n_links": _sums(link_sizes[seq], sizes)}
        lists = {c: pa.array([v], pa.list_(pa.int64())) for c, v in longs.items()} | {"groups_sha256": pa.array([digests], pa.list_(pa.string()))}
        packed = {c: pa.array([_packed(v)], pa.binary()) for c, v in (
            ("sizes", sizes), ("windows", seq), ("link_sizes", link_sizes), ("links", links))}
        found = {c: pa.array([v], pa.list_(pa.int64())) for c, v in (("pairs", pairs), ("times", often))}
        out = pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64())} | lists | packed | found)
        self.rows, self.seq, self.bytes = [], [], 0
        if len(self.windows.texts) > MEMO_WINDOWS:
            self.windows.clear()
        return out


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, compressed byte by byte: all first bytes, then all second ones."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    planes = pa.decompress(packed[8:], decompressed_size=4 * size, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs of the given sizes, empty ones included."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _blocks(batches: Iterator[pa.RecordBatch], first: str, second: str) -> Iterator[pa.RecordBatch]:
    both = tokenizers(first, second)
    block = _Block(Windows(both))
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        lengths = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // PART_CHARS, prepend=0)).tolist()
        for at, to in zip([0, *cuts], [*cuts, batch.num_rows]):
            if at == to:
                continue
            part = batch.slice(at, to - at)  # only so many texts are Python strings at a time
            texts = [t or "" for t in part.column("text").to_pylist()]
            block.add(part.column("id").to_pylist(), [len(t) for t in texts], both.encode(texts))
            if block.bytes >= BLOCK_BYTES:
                yield block.drain(number)
                number += 1
    if block.rows:
        yield block.drain(number)


_OUT = (
    "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _finished(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """The texts of a block; ``found`` has the count of each of its pairs."""
    row = next(block.itertuples(index=False))
    counts, best = np.zeros(len(row.pairs), dtype=np.int64), np.zeros(len(row.pairs), dtype=np.int64)
    counts[found["idx"].to_numpy()] = found["count"].to_numpy()
    best[found["idx"].to_numpy()] = found["best"].to_numpy()
    sizes, seq, link_sizes, links = (_unpacked(x) for x in (row.sizes, row.windows, row.link_sizes, row.links))
    def per_text(values: np.ndarray) -> np.ndarray:
        return _sums(_sums(values[links], link_sizes)[seq], sizes)
    return pd.DataFrame({
        "id": pd.array(list(row.ids), dtype="Int64"), "n_a": row.n_a, "n_b": row.n_b, "n_groups": row.n_groups, "n_links": row.n_links,
        "n_best": per_text(best), "count_sum": per_text(counts), "groups_sha256": row.groups_sha256})


def align_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", first: str = BYTE_LEVEL, second: str = PIECES,
) -> tuple[DataFrame, DataFrame]:
    """Per row ``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, and the table ``(a, b, count, best)`` of linked ids."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    blocks = materialise(rows.mapInArrow(lambda batches: _blocks(batches, first, second), _BLOCK), "aligned")
    linked = blocks.select(F.col("block").alias("place"), F.posexplode(F.arrays_zip("pairs", "times")).alias("idx", "link")).select(
        "place", "idx", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    second_id = F.col("pair").bitwiseAND((1 << _ID_BITS) - 1)
    counted = materialise(linked.groupBy("pair").agg(F.sum("times").alias("count")), "pair_counts")
    highest = counted.groupBy(second_id.alias("b")).agg(F.max("count").alias("high"))
    pairs = materialise(counted.withColumn("b", second_id).join(highest, "b").select(
        "pair", F.shiftright("pair", _ID_BITS).alias("a"), "b", "count", (F.col("count") == F.col("high")).alias("best")), "pairs")
    found = linked.select("place", "idx", "pair").join(pairs.select("pair", "count", "best"), "pair").select("place", "idx", "count", "best")
    done = blocks.drop("times").groupBy("block").cogroup(found.groupBy("place")).applyInPandas(_finished, _OUT)
    return done, pairs.drop("pair")
