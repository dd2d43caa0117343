"""Packing token sequences into windows of several lengths, with no padding.

A document's ids, with an end id, are cut into full long windows; what remains
is routed to the tier (2048, 1024, 512, 256 ids) that it fits.  Tier after tier,
long to short, each window starts with a rest of its own tier and its gap is
filled from shorter ones, the largest that fits first.  When only longer
rests are left, one is cut to close the gap.  The last rests of a task go
into windows of powers of two, so no window needs padding.  Windows of one length
gather in step groups of up to ``GROUP_IDS`` ids.  Up to two groups of each length wait, so that the end of a task is dealt
evenly: its last groups differ by a window at most, and only a task with less than one group's windows of a length makes a small one.

Each task packs what it reads and keeps no more than ``POOL_IDS`` ids waiting;
nothing is shuffled.  A task's windows depend on its rows alone, so a repeated
task agrees with the lost one.

Cases: a NULL text counts as empty, and an empty text is its end id alone;
repeated rows are documents of their own; very long texts are cut where the
tokenizer cuts anyway; an empty table gives an empty result; columns besides
id and text are not read.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
TIERS = (2048, 1024, 512, 256)
POOL_IDS = 1 << 20
GROUP_IDS = 1 << 17
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
END_OF_TEXT = "<|endoftext|>"
PART_CHARS = 1 << 20
# Between a letter and a space before a letter the tokenizer always cuts.
SEAM = re.compile(r"[a-z](?= [a-z])")
# The two libraries are held to agree on these characters; other texts take the slower one.
COMMON = re.compile(r"[\u0000-ɏ]*")

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " window_length int, step_group long"
)


def _place(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoders(tokenizer: str, ranks: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(_place(ranks), "rb") as file:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    fast = tiktoken.Encoding(
        "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={END_OF_TEXT: len(table)})
    return fast, Tokenizer.from_file(_place(tokenizer))


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PART_CHARS:
        seam = SEAM.search(text, at + PART_CHARS)
        if seam is None:
            break
        yield text[at:seam.end()]
        at = seam.end()
    yield text[at:]


def encode(text: str | None, tokenizer: str = TOKENIZER, ranks: str = RANKS) -> np.ndarray:
    """The tokenizer's ids of a text, without end id.

    Texts in common characters go through an equal, faster implementation of the same vocabulary.
    """
    fast, plain = _encoders(tokenizer, ranks)
    ids = []
    for part in _parts(text or ""):
        if COMMON.fullmatch(part):
            ids.append(fast.encode_to_numpy(part, allowed_special={END_OF_TEXT}, disallowed_special=()))
        else:
            ids.append(np.array(plain.encode(part, add_special_tokens=False).ids, dtype=np.uint32))
    return np.concatenate(ids).astype(np.uint32) if len(ids) > 1 else ids[0].astype(np.uint32, copy=False)


class Packer:
    """Windows from rests of documents, for one task."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS, pool_ids: int = POOL_IDS, group_ids: int = GROUP_IDS):
        self.tiers, self.pool_ids, self.group_ids = tiers, pool_ids, group_ids
        self.by_length: dict[int, list] = {}
        self.lengths = 0  # bit n is set where rests of n ids wait
        self.waiting = 0
        self.next_window = self.next_group = task << 33
        self.ungrouped: dict[int, list[list[tuple]]] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.tiers[0]
        for start in range(0, whole, self.tiers[0]):
            self._emit([(doc_id, start, ids[start:start + self.tiers[0]], len(ids))], self.tiers[0])
        if whole < len(ids):
            self._wait((doc_id, whole, ids[whole:].copy(), len(ids)))
        if self.waiting >= self.pool_ids:
            self.pack()

    def _wait(self, rest: tuple) -> None:
        n = len(rest[2])
        self.by_length.setdefault(n, []).append(rest)
        self.lengths |= 1 << n
        self.waiting += n

    def _take(self, n: int) -> tuple:
        rests = self.by_length[n]
        rest = rests.pop()
        if not rests:
            self.lengths &= ~(1 << n)
        self.waiting -= n
        return rest

    def _largest(self, most: int) -> int:
        return (self.lengths & ((2 << most) - 1)).bit_length() - 1

    def _cut(self, n: int, head: int) -> tuple:
        doc_id, start, ids, total = self._take(n)
        self._wait((doc_id, start + head, ids[head:], total))
        return doc_id, start, ids[:head], total

    def _fill(self, size: int, first: int) -> None:
        """One window, begun with a rest of the given length; unfinished ones wait again."""
        window, gap = [self._take(first)], size - first
        while gap and self.lengths:
            fits = self._largest(gap)
            if fits > 0:
                window.append(self._take(fits))
                gap -= fits
            else:
                longer = self.lengths & -self.lengths
                window.append(self._cut(longer.bit_length() - 1, gap))
                gap = 0
        if gap:
            for rest in window:
                self._wait(rest)
        else:
            self._emit(window, size)

    def pack(self, last: bool = False) -> None:
        """Fill windows tier by tier; at the end, the remaining ids go into powers of two."""
        for tier, below in zip(self.tiers, (*self.tiers[1:], 0)):
            while self.waiting >= tier and (longest := self._largest(tier)) > below:
                self._fill(tier, longest)
        while last and self.waiting:
            size = 1 << (min(self.waiting, self.tiers[0]).bit_length() - 1)
            fits = self._largest(size)
            if fits <= 0:
                longer = self.lengths & -self.lengths
                self._emit([self._cut(longer.bit_length() - 1, size)], size)
            else:
                self._fill(size, fits)
        if last:
            self.balance()

    def _emit(self, window: list[tuple], size: int) -> None:
        rows, offset = [], 0
        for doc_id, start, ids, total in window:
            crc = zlib.crc32(ids.astype("<u4", copy=False).tobytes())
            rows.append((doc_id, start, len(ids), crc, total, self.next_window, offset, size))
            offset += len(ids)
        self.next_window += 1
        waiting = self.ungrouped.setdefault(size, [])
        waiting.append(rows)
        full = max(1, self.group_ids // size)
        if len(waiting) == 2 * full:  # what is held back is a whole group still
            self._group(waiting[:full])
            del waiting[:full]

    def _group(self, windows: list[list[tuple]]) -> None:
        self.rows += [(*row, self.next_group) for rows in windows for row in rows]
        self.next_group += 1

    def balance(self) -> None:
        """Deal the windows held back of each length over groups that differ by one window at most."""
        for size, waiting in self.ungrouped.items():
            groups = -(-len(waiting) // max(1, self.group_ids // size))
            for g in range(groups):
                self._group(waiting[g * len(waiting) // groups:(g + 1) * len(waiting) // groups])
        self.ungrouped = {}

    def drain(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window_length", pa.int32()), ("step_group", pa.int64()),
])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def pack(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = TOKENIZER, ranks: str = RANKS,
    tiers: tuple[int, ...] = TIERS,
) -> DataFrame:
    """One row per piece of a document, with its place in a window of ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), tiers)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = encode(text.as_py(), tokenizer, ranks)
                packer.add(doc_id.as_py(), np.append(ids, np.uint32(END_ID)))
                if len(packer.rows) >= 10_000:
                    yield _batch(packer.drain())
        packer.pack()
        packer.pack(last=True)
        if packer.rows:
            yield _batch(packer.drain())

    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(run, SCHEMA)
