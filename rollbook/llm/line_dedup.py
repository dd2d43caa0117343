"""Lines that many documents hold, dropped from all of them but one.

A line's key is the line without white space (space, U+0009 to U+000D) at both ends, A-Z in lower case;
keys of at least ``chars`` code points count.  The 128-bit hashes of distinct keys are
counted by document.  Those of at least ``documents`` documents are dealt to shards by hash, and each
shard becomes a minimal perfect hash (bit levels: a key that is alone on its bit of a level
has that bit's rank as place, the others go on to the next level) over arrays of
fingerprint (64 bits), document count and largest id.  Documents probe the arrays for their
lines; lines are neither joined nor sorted.

An index within ``INDEX_BYTES``, counted before it is read, goes to every task whole.  Beyond that each shard
answers on its own: tasks send it the hashes of their lines in rows of arrays, it
sends back which lines go, and these meet their texts by id and text hash.

Cases: a NULL or empty text is one empty line; rows with the same id are one document, so a line that only they
hold counts once and the rows of the largest id keep all their copies of it; a row with a NULL id counts as no
document and keeps no line that enough documents hold; very long texts and lines are handled whole, batches
are worked off in strips; an empty table gives an empty result; other columns are not read, whatever their names.
Keys are equal by 128 bits of hash, a line is taken for an indexed one by all 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.textkernel import mix
from rollbook.session import materialise

CHARS = 40
DOCUMENTS = 5
# A shard's keys, on average; and the bytes an indexed key takes, places included.
SHARD_KEYS = 1 << 16
KEY_BYTES = 21
INDEX_BYTES = 64 << 20
STRIP_BYTES = 4 << 20
SALTS = 8

_STEP = 0x9E3779B97F4A7C15
_PAIR = np.dtype([("hi", "<u8"), ("lo", "<u8")])


def line_keys(raw: bytes, chars: int = CHARS) -> Iterator[tuple[int, bytes]]:
    """Number and key of each line whose key is long enough."""
    for i, line in enumerate(raw.lower().split(b"\n")):
        key = line.strip()
        if len(key) >= chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= chars):
            yield i, key


def _digest():
    import xxhash

    return xxhash.xxh3_128_digest


def _pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=_PAIR)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _strips(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in runs of rows of bounded size."""
    sizes = rows["text"].str.len().fillna(0).to_numpy(dtype=np.int64)
    strip = (np.cumsum(sizes) - sizes) // STRIP_BYTES
    for _, part in rows.groupby(strip, sort=True):
        yield part


# --- the perfect hash ---------------------------------------------------------------------


def _bit(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    spread = mix(mix(keys["hi"] + np.uint64(level * _STEP & (1 << 64) - 1)) + keys["lo"])
    return (spread % np.uint64(bits)).astype(np.int64)


@dataclass(frozen=True)
class PerfectHash:
    """Distinct 128-bit keys to places 0, 1, ...; other keys to any place or to -1."""

    bits: tuple[int, ...]
    words: np.ndarray

    @staticmethod
    def of(keys: np.ndarray) -> PerfectHash:
        bits, words, left = [], [], keys
        while len(left):
            size = 64 * -(-2 * len(left) // 64)
            place = _bit(left, len(bits), size)
            alone = np.bincount(place, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            bits.append(size)
            left = left[~alone[place]]
        return PerfectHash(tuple(bits), np.concatenate(words) if words else np.empty(0, "<u8"))

    def places(self, keys: np.ndarray) -> np.ndarray:
        before = np.cumsum(np.bitwise_count(self.words).astype(np.int64)) - np.bitwise_count(self.words)
        out = np.full(len(keys), -1, dtype=np.int64)
        left, first = np.arange(len(keys)), 0
        for level, size in enumerate(self.bits):
            bit = _bit(keys[left], level, size)
            word, within = self.words[first + (bit >> 6)], (bit & 63).astype(np.uint64)
            hit = (word >> within) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << within) - np.uint64(1))
            out[left[hit]] = (before[first + (bit >> 6)] + np.bitwise_count(below))[hit]
            left, first = left[~hit], first + size // 64
        return out


@dataclass(frozen=True)
class Shard:
    places: PerfectHash
    fingerprints: np.ndarray
    counts: np.ndarray
    keepers: np.ndarray

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per key the number of documents that hold it (0 where it is not indexed) and the largest of their ids."""
        place = self.places.places(keys)
        found = place >= 0
        found[found] = self.fingerprints[place[found]] == keys["lo"][found]
        counts, keepers = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        counts[found], keepers[found] = self.counts[place[found]], self.keepers[place[found]]
        return counts, keepers


_SHARD = "shard int, bits array<long>, words binary, fingerprints binary, counts binary, keepers binary"


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    keys = np.empty(len(rows), dtype=_PAIR)
    keys["hi"], keys["lo"] = (rows[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("hi", "lo"))
    hashed = PerfectHash.of(keys)
    order = np.argsort(hashed.places(keys))
    counts = np.minimum(rows["n"].to_numpy(dtype=np.int64), (1 << 32) - 1).astype("<u4")
    return pd.DataFrame({
        "shard": rows["shard"].iloc[:1], "bits": [list(hashed.bits)], "words": [hashed.words.tobytes()],
        "fingerprints": [keys["lo"][order].tobytes()], "counts": [counts[order].tobytes()],
        "keepers": [rows["keeper"].to_numpy(dtype="<i8")[order].tobytes()]})


def _opened(row) -> Shard:
    return Shard(
        PerfectHash(tuple(int(b) for b in row.bits), np.frombuffer(row.words, "<u8")), np.frombuffer(row.fingerprints, "<u8"),
        np.frombuffer(row.counts, "<u4"), np.frombuffer(row.keepers, "<i8"))


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return np.mod(keys["hi"].astype(np.int64), shards)


@dataclass(frozen=True)
class Index:
    """All shards of an index, for probing in one task."""

    shards: dict[int, Shard]
    n_shards: int

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, keepers = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        shard = _shard_of(keys, self.n_shards)
        order = np.argsort(shard, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if len(mine) and (own := self.shards.get(int(shard[mine[0]]))) is not None:
                counts[mine], keepers[mine] = own.probe(keys[mine])
        return counts, keepers


def _held(frames: Iterator[pd.DataFrame], chars: int) -> Iterator[pd.DataFrame]:
    """The distinct keys of each document."""
    digest = _digest()
    for rows in frames:
        for part in _strips(rows[rows["id"].notna()]):
            found, ids, sizes = [], [], []
            for doc_id, text in zip(part["id"], part["text"]):
                own = {digest(key) for _, key in line_keys(_raw(text), chars)}
                found.extend(own)
                ids.append(doc_id)
                sizes.append(len(own))
            keys = _pairs(found)
            yield pd.DataFrame({
                "hi": keys["hi"].astype(np.int64), "lo": keys["lo"].astype(np.int64), "id": np.repeat(np.array(ids, dtype=np.int64), sizes)})


def line_index(rows: DataFrame, documents: int = DOCUMENTS, chars: int = CHARS) -> tuple[DataFrame, int, int]:
    """The stored shards over ``(id, text)`` rows, their number, and how many keys they hold."""
    held = rows.mapInPandas(lambda frames: _held(frames, chars), "hi long, lo long, id long")
    # A key many documents hold is spread by id first, and counted in parts before it meets itself.
    counted = held.distinct().groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
    frequent = materialise(counted.filter(F.col("n") >= documents), "lines")
    n = frequent.count()
    shards = max(1, -(-n // SHARD_KEYS))
    dealt = frequent.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int"))
    return materialise(dealt.groupBy("shard").applyInPandas(_built, _SHARD), "line_index"), shards, n


# --- probing ------------------------------------------------------------------------------


def _lines_of(part: pd.DataFrame, chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the lines of a strip, with the row each is in and its number there."""
    digest, found, lines, sizes = _digest(), [], [], []
    for text in part["text"]:
        before = len(found)
        for i, key in line_keys(_raw(text), chars):
            found.append(digest(key))
            lines.append(i)
        sizes.append(len(found) - before)
    return _pairs(found), np.repeat(np.arange(len(part)), sizes), np.array(lines, dtype=np.int64)


def _goes(counts: np.ndarray, keepers: np.ndarray, ids: np.ndarray, known: np.ndarray, documents: int) -> np.ndarray:
    return (counts >= documents) & ~(known & (keepers == ids))


def _ids(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    known = part["id"].notna().to_numpy()
    return part["id"].fillna(0).to_numpy(dtype=np.int64), known


def _without(text: str | None, dropped) -> tuple[str, int]:
    """A text without the lines of these numbers, and how many lines it had."""
    text = text or ""
    if not len(dropped):
        return text, text.count("\n") + 1
    lines = text.split("\n")
    gone = set(int(i) for i in dropped)
    return "\n".join(line for i, line in enumerate(lines) if i not in gone), len(lines)


_KEPT = "id long, text string, n_lines long, n_dropped long"


def _kept(part: pd.DataFrame, dropped: list) -> pd.DataFrame:
    texts, sizes = zip(*(_without(text, gone) for text, gone in zip(part["text"], dropped)))
    return pd.DataFrame({"id": part["id"].array, "text": texts, "n_lines": sizes, "n_dropped": [len(gone) for gone in dropped]})


def _probe_whole(rows: DataFrame, index: DataFrame, shards: int, documents: int, chars: int) -> DataFrame:
    """Every task probes the whole index."""
    held = rows.sparkSession.sparkContext.broadcast(Index({r.shard: _opened(r) for r in index.collect()}, shards))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            for part in _strips(batch):
                keys, row, line = _lines_of(part, chars)
                ids, known = _ids(part)
                goes = _goes(*held.value.probe(keys), ids[row], known[row], documents)
                row, line = row[goes], line[goes]
                yield _kept(part, np.split(line, np.searchsorted(row, np.arange(1, len(part)))))

    return rows.mapInPandas(run, _KEPT)


_PROBE = "shard int, salt int, keys binary, ids binary, known binary, texts binary, lines binary"


def _probe_shards(rows: DataFrame, index: DataFrame, shards: int, documents: int, chars: int) -> DataFrame:
    """Each shard answers the tasks' questions; its arrays are repeated per salt, for lines that a third of all rows hold."""
    marked = rows.withColumn("text_key", F.xxhash64("text"))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            for part in _strips(batch):
                keys, row, line = _lines_of(part, chars)
                ids, known = _ids(part)
                texts = part["text_key"].to_numpy(dtype=np.int64)
                shard = _shard_of(keys, shards)
                order = np.argsort(shard, kind="stable")
                groups = [g for g in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(g)]
                yield pd.DataFrame([{
                    "shard": shard[g[0]], "salt": int(texts[row[g[0]]] % SALTS), "keys": keys[g].tobytes(), "ids": ids[row[g]].tobytes(),
                    "known": known[row[g]].tobytes(), "texts": texts[row[g]].tobytes(), "lines": line[g].tobytes()}
                    for g in groups], columns=["shard", "salt", "keys", "ids", "known", "texts", "lines"])

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = own = None
        for batch in frames:
            for r in batch.itertuples(index=False):
                if r.words is not None:
                    shard, own = (r.shard, r.salt), _opened(r)
                elif (r.shard, r.salt) == shard:
                    keys, ids, known = np.frombuffer(r.keys, _PAIR), np.frombuffer(r.ids, "<i8"), np.frombuffer(r.known, bool)
                    goes = _goes(*own.probe(keys), ids, known, documents)
                    yield pd.DataFrame({
                        "_id": pd.array(ids[goes], dtype="Int64").copy(), "text_key": np.frombuffer(r.texts, "<i8")[goes],
                        "line": np.frombuffer(r.lines, "<i8")[goes], "known": known[goes]})

    asked = marked.mapInPandas(ask, _PROBE)
    spread = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = asked.unionByName(spread, allowMissingColumns=True)
    # a shard's arrays come before its questions
    placed = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("words").isNull())
    gone = placed.mapInPandas(answer, "_id long, text_key long, line long, known boolean").groupBy("_id", "known", "text_key").agg(
        F.collect_set("line").alias("dropped"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            for part in _strips(batch):
                yield _kept(part, [[] if d is None else d for d in part["dropped"]])

    keyed = marked.withColumn("known", F.col("id").isNotNull()).withColumn("_id", F.coalesce("id", F.lit(0)))
    met = keyed.join(gone, ["_id", "known", "text_key"], "left")
    return met.select("id", "text", "dropped").mapInPandas(cut, _KEPT)


def drop_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", documents: int = DOCUMENTS, chars: int = CHARS,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """``(id, text, n_lines, n_dropped)`` per row: the text without the lines that go, and their number; ids are whole numbers."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    index, shards, keys = line_index(rows, documents, chars)
    probe = _probe_whole if keys * KEY_BYTES <= index_bytes else _probe_shards
    return probe(rows, index, shards, documents, chars)
