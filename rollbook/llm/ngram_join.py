"""Groups of near-equal documents: exact Jaccard join on sets of word n-grams.

Equal sets collapse to one node first.  For the others, grams have one global
order, rare ones first.  How often a gram occurs is read from a sketch of fixed size: counts
of grams by hash place, over all texts.  Two sets that reach the threshold share at least g + 1
grams of their prefixes when these are extended by g.  So either they share a
rare gram there, which is a signature by itself, or g + 1 frequent ones, of which two
fall into the same of g classes: pairs within a class are signatures too.  With
g in proportion to the set's size a set has signatures in proportion to its size.

Only groups are asked for, so pairs inside a found group need no check.  The members
of a signature are compared with one hub, groups are formed, and this is repeated with
other hubs; at last every pair that shares a signature and lies in
different groups is compared.  A comparison looks at parity bitmaps, whose differing
bits bound the difference of two sets from below, and then at the whole sets.  Members of large signatures, which share many
of them, are posted anew by pieces of their bitmaps: with more pieces than two sets within the threshold may differ
in places, one piece is equal.  Large groups of equal pieces are compared
inside tasks, block against block; what leaves a task are links that join groups, fewer than there are members.

Cases: a NULL text or one without words has an empty set and links with nothing;
a shorter text is one gram; rows with a NULL id join groups but never name them; repeated
rows are equal sets; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.textkernel import as_bytes, distinct, mix, windows, word_hashes
from rollbook.operators.joins import spread_join
from rollbook.session import materialise, shuffles_go

N = 3
PERCENT = 90
# Places of the sketch of counts, and of its parts that travel as a row.
PLACE_BITS = 22
CHUNK_BITS = 16
SHARDS = 64
STRETCH_GRAMS = 1 << 20
# A gram is frequent if its place counts more than so many times the mean, and more than so many.
FREQUENT_TIMES = 4
FREQUENT_LEAST = 16
CLASS_GRAMS = 7  # log2 of the set size per class of frequent grams
LEAST_BITS = 10
HUB_ROUNDS = 2
# Signatures with more members than this are compared inside tasks, in blocks of about so many.
FEW_MEMBERS = 16
BLOCK_MEMBERS = 512
BLOCK_BYTES = 8 << 20
# Below this threshold pieces of bitmaps are too short to tell sets apart, and signatures stay as they are.
PIECES_FROM_PERCENT = 80
PIECES_ROWS = 1 << 16
SALTS = 8
# Bytes of texts or sets worked off at a time inside a task, besides the Arrow batch they lie in.
PART_BYTES = 1 << 21

# Places of the map that tells which texts to read again: 1 MB, whatever the number of texts.
MAP_BITS = 23


def gram_sets(texts, n: int = N) -> Iterator[np.ndarray]:
    """The distinct n-grams of each text as sorted hashes."""
    return _sets_of_bytes(as_bytes(texts), n)


def _sets_of_bytes(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    for words in word_hashes(texts):
        yield distinct(windows(words, n))


def _in_parts(batches: Iterator[pa.RecordBatch], *wide: str) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about ``PART_BYTES`` of their wide columns; a part shares its batch's memory."""
    for batch in batches:
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in wide)
        part = (np.cumsum(sizes) - sizes) // PART_BYTES
        cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), batch.num_rows]
        for first, last in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(first, last - first)


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]


def _digest(grams: np.ndarray) -> int | None:
    """A set's node: 64 bits of hash, none for the empty set."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "big", signed=True) if len(grams) else None


def least_overlap(size: int, percent: int = PERCENT) -> int:
    """Grams that a set of this size shares at least with any partner."""
    return -(-percent * size // 100)


def most_size(size: int, percent: int = PERCENT) -> int:
    return 100 * size // percent


@dataclass(frozen=True)
class Sketch:
    """How often grams occur, by hash place: steps of a quarter octave, and the step from which they are frequent."""

    steps: np.ndarray
    frequent: int

    @staticmethod
    def of(counts: np.ndarray) -> Sketch:
        def step(count):
            return np.floor(4 * np.log2(1.0 + count)).astype(np.uint8)
        return Sketch(step(counts), int(step(np.float64(max(FREQUENT_LEAST, FREQUENT_TIMES * counts.mean())))))

    def order(self, grams: np.ndarray) -> tuple[np.ndarray, int]:
        """Sorted distinct grams, rare ones first, and how many are rare."""
        bits = np.uint64(64 - (len(self.steps).bit_length() - 1))
        steps = self.steps[(mix(grams) >> bits).astype(np.int64)]
        order = np.argsort(steps, kind="stable")
        return grams[order], int((steps < self.frequent).sum())


def signatures(grams: np.ndarray, sketch: Sketch, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a set, as signed longs: two sets within the threshold share one."""
    size = len(grams)
    need = least_overlap(size, percent)
    if not size or most_size(size, percent) == size and need == size:
        return np.empty(0, dtype=np.int64)
    ordered, rare = sketch.order(grams)
    own = size.bit_length() - 1
    out = []
    for tier in range(own, most_size(size, percent).bit_length()):
        classes = max(1, (1 << tier) >> CLASS_GRAMS)
        length = min(size, size - need + 1 + min(classes, need - 1))
        out.append(ordered[:min(length, rare)])
        mine = ordered[rare:length]
        kind = mix(mine + np.uint64(tier)) % np.uint64(classes)
        for k in np.unique(kind):
            member = np.sort(mine[kind == k])
            a, b = np.triu_indices(len(member), 1)
            out.append(mix(mix(member[a]) * np.uint64(3) + member[b] + np.uint64(tier + 1)))
    return distinct(np.concatenate(out)).view(np.int64)


def bitmap(grams: np.ndarray) -> bytes:
    """Parities of the grams over a power of two of places, two to four times as many as grams."""
    bits = max(LEAST_BITS, len(grams).bit_length() + 1)
    places = np.bincount((mix(grams) & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return np.packbits((places & 1).astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets from their bitmaps; the larger one is folded."""
    x, y = np.unpackbits(np.frombuffer(a, np.uint8)), np.unpackbits(np.frombuffer(b, np.uint8))
    if len(x) < len(y):
        x, y = y, x
    folded = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int((folded ^ y).sum())


def _counted(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Counts of the grams of a task's sets by place, in compressed chunks; equal sets close together count once."""
    counts = np.zeros(1 << PLACE_BITS, dtype=np.uint32)
    held, size, seen = [], 0, set()

    def add() -> None:
        np.add.at(counts, (mix(np.concatenate(held)) >> np.uint64(64 - PLACE_BITS)).astype(np.int64), np.uint32(1))

    for part in _in_parts(batches, "text"):
        for grams in _sets_of_bytes(_texts(part), n):
            digest = _digest(grams)
            if digest is None or digest in seen:
                continue
            seen.add(digest)
            held.append(grams)
            size += len(grams)
            if size >= STRETCH_GRAMS:
                add()
                held, size, seen = [], 0, set()
    if held:
        add()
    if counts.any():
        shard = TaskContext.get().partitionId() % SHARDS
        for chunk in range(1 << PLACE_BITS - CHUNK_BITS):
            part = counts[chunk << CHUNK_BITS:chunk + 1 << CHUNK_BITS]
            packed = zlib.compress(part.astype("<u8").tobytes(), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int32()), pa.array([shard], pa.int32()), pa.array([packed], pa.binary())], ["chunk", "shard", "counts"])


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(c), "<u8") for c in rows["counts"])
    return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "shard": [0], "counts": [zlib.compress(total.tobytes(), 1)]})


def sketch_of(texts: DataFrame, n: int = N) -> Sketch:
    """The sketch over all texts.  Its size is fixed, so it may come to the driver and go to every task.

    The order of grams depends on it, the groups found do not.
    """
    fields = "chunk int, shard int, counts binary"
    parts = texts.mapInArrow(lambda batches: _counted(batches, n), fields).groupBy("chunk", "shard").applyInPandas(_added, fields)
    with shuffles_go(texts.sparkSession):
        added = parts.groupBy("chunk").applyInPandas(_added, fields).collect()
    counts = np.zeros(1 << PLACE_BITS, dtype=np.uint64)
    for r in added:
        counts[r["chunk"] << CHUNK_BITS:r["chunk"] + 1 << CHUNK_BITS] = np.frombuffer(zlib.decompress(r["counts"]), "<u8")
    return Sketch.of(counts)


def _described(docs: DataFrame, sketch: Sketch, percent: int, n: int) -> DataFrame:
    """``(id, row_key, node, n, signatures, bitmap)`` per row."""
    kind = docs.schema["id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _in_parts(batches, "text"):
            sets = list(_sets_of_bytes(_texts(part), n))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("row_key"), pa.array([_digest(g) for g in sets], pa.int64()),
                 pa.array([len(g) for g in sets], pa.int32()), pa.array([signatures(g, held.value, percent) for g in sets], pa.list_(pa.int64())),
                 pa.array([bitmap(g) for g in sets], pa.binary())], ["id", "row_key", "node", "n", "signatures", "bitmap"])

    return docs.mapInArrow(describe, f"id {kind}, row_key long, node long, n int, signatures array<long>, bitmap binary")


def _whole_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for part in _in_parts(batches, "text"):
        sets = list(_sets_of_bytes(_texts(part), n))
        yield pa.RecordBatch.from_arrays(
            [pa.array([_digest(g) for g in sets], pa.int64()), pa.array([g.tobytes() for g in sets], pa.binary())], ["node", "grams"])


def _sets_of(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``(node, grams)`` of the rows whose key is wanted.

    A bitmap of fixed size over the wanted keys sorts out nearly all other
    texts before the join, so that few are shuffled.
    """
    place = F.pmod("row_key", F.lit(1 << MAP_BITS)) + 1
    marks = wanted.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.expr("shiftright(_byte, cast(_bit & 7 as int)) & 1") == 1
    likely = (
        rows.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(marks), "_bucket")
        .withColumn("_byte", byte).withColumn("_bit", bit).filter(marked).select("row_key", "text")
    )
    texts = likely.join(wanted, "row_key", "left_semi").select("text")
    return texts.mapInArrow(lambda batches: _whole_sets(batches, n), "node long, grams binary").dropDuplicates(["node"])


def _close_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _side(table: DataFrame, name: str, *columns: str) -> DataFrame:
    return table.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that the bitmaps do not rule out."""
    @F.pandas_udf("boolean")
    def may(x: pd.Series, y: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        # the difference is at most (100 - percent) / (100 + percent) of both sizes
        return pd.Series([
            least_difference(a, b) * (100 + percent) <= (100 - percent) * (int(p) + int(q)) for a, b, p, q in zip(x, y, na, nb)])

    return (
        pairs.join(_side(nodes, "a", "bitmap", "n"), "a").join(_side(nodes, "b", "bitmap", "n"), "b")
        .filter(may("bitmap_a", "bitmap_b", "n_a", "n_b")).select("a", "b")
    )


def _links(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the threshold."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _in_parts(batches, "grams_a", "grams_b"):
            linked = []
            for a, b in zip(part.column("grams_a"), part.column("grams_b")):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
            yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    pairs = near.join(_side(sets, "a", "grams"), "a").join(_side(sets, "b", "grams"), "b").select("a", "b", "grams_a", "grams_b")
    return pairs.mapInArrow(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node with an edge; the root is the group's smallest node.

    Each round moves every node to its smallest neighbour and contracts the
    edges.  Nodes are digests, in random order, so the edges vanish in about
    as many rounds as the logarithm of their number.
    """
    edges = materialise(edges.select("a", "b").distinct(), "edges")
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    labels = None
    while not both.isEmpty():
        moved = materialise(
            both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "moved")
        if labels is None:
            labels = moved
        else:
            step = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = materialise(spread_join(labels, step, ["root"], ["node"], "left", SALTS).select(
                "node", F.coalesce("next", "root").alias("root")), "labels")
        ends = spread_join(both, moved, ["node"], ["other"], "inner", SALTS).select(F.col("root").alias("from"), F.col("other").alias("node"))
        both = materialise(
            spread_join(ends, moved, ["node"], ["from"], "inner", SALTS).filter(F.col("from") != F.col("root"))
            .select(F.col("from").alias("node"), F.col("root").alias("other")).distinct(), "contracted")
    return both.select("node", F.col("other").alias("root")) if labels is None else labels


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of signatures that still lie in several groups, with their group."""
    grouped = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = grouped.groupBy("signature").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("signature")
    return grouped.join(several, "signature")


def _hub_pairs(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each member of a signature with the signature's hub of this turn, unless they are in one group already."""
    order = F.xxhash64("node", F.lit(turn)).alias("order")
    hubs = members.groupBy("signature").agg(
        F.min(F.struct(order, F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("root").alias("hub_root"))).alias("h"))
    return (
        members.join(hubs.select("signature", "h.*"), "signature")
        .filter((F.col("root") != F.col("hub_root")) & _close_sizes(F.col("n"), F.col("hub_n"), percent))
        .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    )


def _pairs_of_few(members: DataFrame, percent: int) -> DataFrame:
    """All pairs that share a signature of few members, lie in different groups and have sizes within the threshold."""
    other = members.select("signature", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"))
    return (
        members.withColumnRenamed("node", "a").join(other, "signature")
        .filter((F.col("a") < F.col("b")) & (F.col("root") != F.col("root_b")) & _close_sizes(F.col("n"), F.col("n_b"), percent))
        .select("a", "b").distinct()
    )


def _folded(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of one array, folded to the shortest."""
    width = min(map(len, bitmaps))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, width), axis=0) for b in bitmaps])


def _near_to(x: int, others: np.ndarray, marks: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Those of the other rows that neither sizes nor bitmaps rule out."""
    y = others[100 * np.minimum(sizes[others], sizes[x]) >= percent * np.maximum(sizes[others], sizes[x])]
    least = np.bitwise_count(marks[y] ^ marks[x]).sum(axis=1, dtype=np.int64)
    return y[least * (100 + percent) <= (100 - percent) * (sizes[y] + sizes[x])]


class _Together:
    """Members of block i of a signature against those of block j."""

    def __init__(self, rows: pd.DataFrame, percent: int):
        self.percent = percent
        self.marks = _folded(list(rows["bitmap"]))
        self.sizes, self.nodes, self.block = (rows[c].to_numpy(dtype=np.int64) for c in ("n", "node", "block"))
        self.i, self.j = rows["i"].iloc[0], rows["j"].iloc[0]
        self.group = np.unique(rows["root"].to_numpy(), return_inverse=True)[1]
        self.rows = rows

    def _candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        for x in np.flatnonzero(self.block == self.i):
            others = (self.block == self.j) & (self.group != self.group[x])
            if self.i == self.j:
                others &= self.nodes > self.nodes[x]
            y = _near_to(x, np.flatnonzero(others), self.marks, self.sizes, self.percent)
            if len(y):
                yield x, y

    def near(self) -> pd.DataFrame:
        """The members that may have a partner in another group."""
        hit = np.zeros(len(self.nodes), dtype=bool)
        for x, y in self._candidates():
            hit[x] = hit[y] = True
        return pd.DataFrame({"node": self.nodes[hit]})

    def links(self) -> pd.DataFrame:
        """Verified links that join groups: at most one less than there are members.

        A member is counted against all its candidates at once; those of its own group need no check any more.
        """
        sets = [np.frombuffer(g, np.uint64) for g in self.rows["grams"]]
        used, place = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(self.sizes)
        parts = [place[e - n:e] for e, n in zip(ends, self.sizes)]
        mark, a, b = np.zeros(len(used), dtype=np.int64), [], []
        for x, y in self._candidates():
            mark[parts[x]] = 1
            first = np.cumsum(self.sizes[y]) - self.sizes[y]
            both = np.add.reduceat(mark[np.concatenate([parts[k] for k in y])], first)
            mark[parts[x]] = 0
            for k in y[100 * both >= self.percent * (self.sizes[y] + self.sizes[x] - both)]:
                if self.group[k] != self.group[x]:
                    self.group[self.group == self.group[k]] = self.group[x]
                    a.append(min(self.nodes[x], self.nodes[k]))
                    b.append(max(self.nodes[x], self.nodes[k]))
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})


def _compared(percent: int, found):
    """``found`` of each group of rows sorted by (signature, i, j)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for rows in frames:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            key = rows[["signature", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
            for first, last in zip(starts[:-1], starts[1:]):  # the last one may go on
                yield found(_Together(rows.iloc[first:last], percent))
            held = rows.iloc[starts[-1]:]
        if held is not None:
            yield found(_Together(held, percent))
    return run


def _dealt(members: DataFrame, more: DataFrame, *columns: str) -> DataFrame:
    """Members of signatures in blocks of bounded size, once per pair of blocks they are in."""
    wide = F.greatest(F.col("members") / BLOCK_MEMBERS, F.col("grams_in_all") * 8 / BLOCK_BYTES)
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = members.withColumn("blocks", F.ceil(wide)).withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    dealt = placed.join(more, "node").select(
        "signature", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "root", *columns)
    return dealt.repartition("signature", "i", "j").sortWithinPartitions("signature", "i", "j")


def size_tiers(most: int, percent: int) -> list[int]:
    """Smallest sizes of tiers up to ``most``: a set's partners within the threshold lie in its own tier or a neighbouring one."""
    lows = [1]
    while lows[-1] <= most:
        lows.append(most_size(lows[-1], percent) + 1)
    return lows


def pieces(mark: bytes, size: int, lows: list[int], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set from its bitmap, as signed longs, in its own size tier and in the next: two sets within the threshold share one
    in the larger one's own tier.

    There they differ in so many places at most; of one piece more, one is equal in both.
    """
    own, out = bisect.bisect_right(lows, size) - 1, []
    for tier in (own, own + 1):
        width = 1 << max(LEAST_BITS, lows[max(tier - 1, 0)].bit_length() + 1)
        most = (100 - percent) * 2 * (most_size(lows[tier], percent)) // (100 + percent)
        places = np.flatnonzero(np.unpackbits(np.bitwise_xor.reduce(np.frombuffer(mark, np.uint8).reshape(-1, width // 8), axis=0)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(places.astype(np.uint64) + np.uint64(1)))))
        number = np.arange(most + 2)
        held = sums[np.searchsorted(places, number * width // (most + 1))]
        out.append(mix(held[1:] - held[:-1] + mix(number[:-1].astype(np.uint64) + (np.uint64(tier + 1) << np.uint64(32)))).view(np.int64))
    return tuple(out)


def _in_pieces(many: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``(signature, node, n, root)`` of the members of large signatures, each once per piece of its bitmap.

    Pieces that only one group has, or no set in its own tier, are left out.
    """
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            lows = size_tiers(2 * int(sizes.max(initial=1)), percent)
            held, counts, rows, first = [], [], 0, 0
            for at, (mark, size) in enumerate(zip(batch.column("bitmap"), sizes.tolist())):
                keys = pieces(mark.as_py(), size, lows, percent)
                held += keys
                counts += map(len, keys)
                rows += sum(counts[-2:])
                if rows >= PIECES_ROWS or at + 1 == batch.num_rows:
                    row = np.repeat(np.arange(len(counts)), counts)
                    own = batch.select(["node", "n", "root"]).take(pa.array(first + row // 2))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(held)), *own.columns, pa.array(row % 2 == 0)], ["signature", "node", "n", "root", "own_tier"])
                    held, counts, rows, first = [], [], 0, at + 1

    once = many.select("node", "n", "root").distinct().join(nodes.select("node", "bitmap"), "node")
    posted = materialise(once.mapInArrow(post, "signature long, node long, n int, root long, own_tier boolean"), "pieces")
    used = posted.groupBy("signature").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("own_tier").alias("used"))
    return materialise(posted.drop("own_tier").join(used.filter("low <> high AND used").select("signature"), "signature"), "open_pieces")


def _counted_members(members: DataFrame) -> DataFrame:
    sums = members.groupBy("signature").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("grams_in_all"))
    return materialise(members.join(sums, "signature"), "counted")


def _near_members(many: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The members of large signatures whose bitmaps allow a partner in another group."""
    dealt = _dealt(many, nodes.select("node", "bitmap"), "bitmap")
    return materialise(dealt.mapInPandas(_compared(percent, _Together.near), "node long").distinct(), "near_members")


def _links_of_many(many: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within large signatures: blocks against blocks, verified where they meet, no more than join groups."""
    dealt = _dealt(many, nodes.select("node", "bitmap").join(sets, "node"), "bitmap", "grams")
    return dealt.mapInPandas(_compared(percent, _Together.links), "a long, b long").distinct()


class _Sets:
    """Whole sets of nodes, read again from the texts when they are first wanted."""

    def __init__(self, nodes: DataFrame, rows: DataFrame, n: int):
        self.nodes, self.rows, self.n, self.held = nodes, rows, n, None

    def of(self, wanted: DataFrame) -> DataFrame | None:
        wanted = wanted.select("node").distinct()
        if self.held is not None:
            wanted = wanted.join(self.held.select("node"), "node", "left_anti")
        keys = materialise(wanted.join(self.nodes, "node").select("place.row_key"), "wanted")
        if self.held is None or not keys.isEmpty():
            more = materialise(_sets_of(self.rows, keys, self.n), "sets")
            self.held = more if self.held is None else self.held.unionByName(more)
        return self.held


def _verified(near: DataFrame, sets: _Sets, percent: int) -> DataFrame | None:
    near = materialise(near, "near")
    if near.isEmpty():
        return None
    whole = sets.of(near.select(F.explode(F.array("a", "b")).alias("node")))
    return materialise(_links(near, whole, percent), "links")


def _split(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of signatures that have few, and those of the others with their number."""
    counted = _counted_members(members)
    return counted.filter(F.col("members") <= FEW_MEMBERS).drop("members", "grams_in_all"), counted.filter(F.col("members") > FEW_MEMBERS)


def _open_links(members: DataFrame, nodes: DataFrame, sets: _Sets, percent: int) -> list[DataFrame | None]:
    """Links that join all groups which pairs sharing a signature still join."""
    few, many = _split(members)
    pairs = _pairs_of_few(few, percent)
    if percent >= PIECES_FROM_PERCENT and not many.isEmpty():
        more, many = _split(_in_pieces(many, nodes, percent))
        pairs = pairs.unionByName(_pairs_of_few(more, percent)).distinct()
    out = [_verified(_near(pairs, nodes, percent), sets, percent)]
    if not many.isEmpty():
        near = _near_members(many, nodes, percent)
        if not near.isEmpty():
            whole = sets.of(near)
            left = _counted_members(many.drop("members", "grams_in_all").join(near, "node", "left_semi"))
            out.append(materialise(_links_of_many(left, nodes, whole, percent), "links"))
    return out


def _roots(members: DataFrame, nodes: DataFrame, rows: DataFrame, percent: int, n: int) -> DataFrame:
    """``(node, root)`` of all linked nodes: hubs first, then every pair that is still open."""
    roots = members.select("node", F.col("node").alias("root")).limit(0)
    edges, sets = None, _Sets(nodes, rows, n)
    for turn in range(HUB_ROUNDS + 1):
        still = materialise(_mixed(members, roots), "mixed")
        if still.isEmpty():
            break
        if turn < HUB_ROUNDS:
            found = [_verified(_near(_hub_pairs(still, turn, percent), nodes, percent), sets, percent)]
        else:
            found = _open_links(still, nodes, sets, percent)
        found = [links for links in found if links is not None and not links.isEmpty()]
        if not found:
            continue
        for links in found:
            edges = links if edges is None else edges.unionByName(links)
        roots = components(edges)
    return roots


def row_key(id_column: str, text_column: str) -> Column:
    """A row by its id and text, 64 bits of hash; never NULL."""
    return F.xxhash64(id_column, F.xxhash64(F.col(text_column).cast("string")))


def near_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT, n: int = N,
) -> DataFrame:
    """Per row of ``docs``: ``id``, ``row_key``, ``n_grams``, ``group_id`` (the smallest id of its group) and ``group_key``.

    Sets of ``n``-word grams are near from a Jaccard similarity of ``percent`` / 100 on.
    """
    rows = docs.select(
        F.col(id_column).alias("id"), row_key(id_column, text_column).alias("row_key"), F.col(text_column).cast("string").alias("text"))
    described = materialise(_described(rows, sketch_of(rows.select("text"), n), percent, n), "described")

    filled = described.filter("node IS NOT NULL")
    nodes = materialise(filled.groupBy("node").agg(
        F.min(F.struct("id", "row_key")).alias("place"), F.min("id").alias("id"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap")), "nodes")
    posted = filled.select(F.explode("signatures").alias("signature"), "node", "n")
    shared = posted.groupBy("signature").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("signature")
    members = materialise(posted.join(shared, "signature").distinct(), "members")
    roots = _roots(members, nodes, rows, percent, n)

    grouped = nodes.select("node", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = grouped.groupBy("root").agg(F.min("id").alias("group_id"))
    named = spread_join(grouped, names, ["root"], ["node"], "inner", SALTS).select("node", "root", "group_id")
    full = spread_join(filled.select("node", "id", "row_key", "n"), named, ["node"], ["id"], "inner", SALTS)
    return full.select("id", "row_key", F.col("n").cast("long").alias("n_grams"), "group_id", F.col("root").alias("group_key")).unionByName(
        described.filter("node IS NULL").select(
            "id", "row_key", F.lit(0).cast("long").alias("n_grams"), F.col("id").alias("group_id"), F.lit(None).cast("long").alias("group_key")))
