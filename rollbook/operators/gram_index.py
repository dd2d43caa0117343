"""A trigram index: for each run of three characters, which rows of a table hold it, as bitmaps.

Tasks read the table where it lies and give their rows dense numbers in segments of 32,768, the size of
Spark's bitmaps.  A segment has one posting per gram: the bitmap of its rows, or their numbers where that is shorter.
Texts are not moved, and a posting list costs at most one bit per row.  A lookup takes the intersection over
all grams of a term within each segment, and the union over terms and columns; what stands is verified.

The index repays its build only when many searches run against the same register.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators.lexical import fold_terms, scan_search, shadow
from rollbook.operators.reduction import reduced_semi_join
from rollbook.session import literal_frame, scratch_path

GRAM = 3
# The empty gram marks every row that went through the build.
INDEXED = ""
SEGMENT_ROWS = 1 << 15
SEGMENT_GRAMS = 1 << 21
# Bytes of texts turned into Python strings, and postings written, at a time.
PART_BYTES = 1 << 21
BATCH_POSTINGS = 1 << 14
_BITMAP_BYTES = SEGMENT_ROWS // 8

_POSTINGS = "column_id string, gram string, segment long, n_records long, bits binary, places array<short>"


@dataclass(frozen=True)
class GramIndex:
    """``postings`` (column_id, gram, segment, n_records, bits or places) and ``rows`` (segment, place, id)."""

    postings: DataFrame
    rows: DataFrame


def _grams(text: str) -> np.ndarray:
    """The distinct grams of a text, each as 63 bits."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    return np.unique(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])


def _names(codes: np.ndarray) -> list[str]:
    mask = np.uint64((1 << 21) - 1)
    parts = np.stack([codes >> np.uint64(42), codes >> np.uint64(21) & mask, codes & mask], axis=1).astype("<u4")
    joined = parts.tobytes().decode("utf-32-le")
    return [joined[i:i + GRAM] for i in range(0, len(joined), GRAM)]


def _bits(places: np.ndarray, rows: int) -> bytes:
    out = np.zeros(8 * -(-rows // 8), dtype=np.uint8)
    out[places] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _postings(column: str, grams: np.ndarray, places: np.ndarray, segment: int, rows: int) -> Iterator[dict]:
    """A segment's postings of one column, the empty gram first, so many at a time."""
    yield {"column_id": [column], "gram": [INDEXED], "segment": [segment], "n_records": [rows], "bits": [_bits(np.arange(rows), rows)]}
    order = np.argsort(grams, kind="stable")
    grams, places = grams[order], places[order]
    del order
    starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.empty(0, dtype=np.int64)
    ends = np.append(starts[1:], len(grams))
    for at in range(0, len(starts), BATCH_POSTINGS):
        first, last = starts[at:at + BATCH_POSTINGS], ends[at:at + BATCH_POSTINGS]
        sizes = last - first
        dense = 16 * sizes > rows
        bits = [_bits(places[s:e], rows) if d else None for s, e, d in zip(first, last, dense)]
        kept = places[first[0]:last[-1]][np.repeat(~dense, sizes)]
        offsets = np.concatenate(([0], np.cumsum(np.where(dense, 0, sizes)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(kept), mask=pa.array(dense))
        yield {
            "column_id": [column] * len(sizes), "gram": _names(grams[first]), "segment": [segment] * len(sizes),
            "n_records": sizes, "bits": bits, "places": lists}


class _Segment:
    def __init__(self, columns: Sequence[str]):
        self.columns = columns
        self.ids: list = []
        self.held: dict[str, list[tuple[int, np.ndarray]]] = {c: [] for c in columns}
        self.grams = 0

    def add(self, row_id, texts: Sequence[str | None]) -> None:
        for column, text in zip(self.columns, texts):
            if text is not None and len(text) >= GRAM:
                found = _grams(text)
                self.held[column].append((len(self.ids), found))
                self.grams += len(found)
        self.ids.append(row_id)

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_ROWS or self.grams >= SEGMENT_GRAMS

    def drain(self, segment: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for column in self.columns:
            held = self.held.pop(column)
            # a place is below the rows of a segment, 15 bits
            places = np.repeat(np.array([r for r, _ in held], dtype=np.int16), [len(g) for _, g in held])
            grams = np.concatenate([g for _, g in held]) if held else np.empty(0, dtype=np.uint64)
            del held
            for postings in _postings(column, grams, places, segment, len(self.ids)):
                yield _batch(schema, postings)
        yield _batch(schema, {"segment": [segment] * len(self.ids), "place": list(range(len(self.ids))), "id": self.ids})


def _batch(schema: pa.Schema, values: dict) -> pa.RecordBatch:
    n = len(values["segment"])
    columns = [values[f.name] if f.name in values else [None] * n for f in schema]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``PART_BYTES`` of its texts, the columns behind the first."""
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for texts in batch.columns[1:]:
        sizes += pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // PART_BYTES
    cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), batch.num_rows]
    for first, last in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(first, last - first)


def write_index(df: DataFrame, id_column: str, columns: Sequence[str], path: str, clean: bool = False) -> GramIndex:
    """Index the columns of a table under ``path``; one pass over its texts, which stay where they are."""
    spark = df.sparkSession
    kind = df.schema[id_column].dataType
    searched = df.select(F.col(id_column), *[shadow(c, clean).alias(f"_{i}") for i, c in enumerate(columns)])
    fields = f"{_POSTINGS}, place int, id {kind.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, number = _Segment(columns), TaskContext.get().partitionId() << 32
        schema = None
        for batch in batches:
            schema = schema or pa.schema([
                ("column_id", pa.string()), ("gram", pa.string()), ("segment", pa.int64()), ("n_records", pa.int64()), ("bits", pa.binary()),
                ("places", pa.list_(pa.int16())), ("place", pa.int32()), ("id", batch.schema.field(0).type)])
            for part in _in_parts(batch):
                for row_id, *texts in zip(*(c.to_pylist() for c in part.columns)):
                    segment.add(row_id, texts)
                    if segment.full():
                        yield from segment.drain(number, schema)
                        segment, number = _Segment(columns), number + 1
        if segment.ids:
            yield from segment.drain(number, schema)

    both = scratch_path(spark, "segments")
    searched.mapInArrow(run, fields).write.parquet(both)
    stored = spark.read.schema(fields).parquet(both)
    # a gram's postings sit together, so that a lookup skips row groups
    (stored.filter("gram IS NOT NULL").drop("place", "id").repartitionByRange("column_id", "gram", "segment")
     .sortWithinPartitions("column_id", "gram", "segment").write.mode("overwrite").parquet(f"{path}/postings"))
    stored.filter("gram IS NULL").select("segment", "place", F.col("id").alias(id_column)).write.mode("overwrite").parquet(f"{path}/rows")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> GramIndex:
    return GramIndex(*(spark.read.parquet(f"{path}/{part}") for part in ("postings", "rows")))


def gram_frequencies(index: GramIndex) -> DataFrame:
    """How many rows hold each gram."""
    return index.postings.groupBy("column_id", "gram").agg(F.sum("n_records").alias("n_records"))


def indexed_ids(index: GramIndex, id_column: str) -> DataFrame:
    """Ids that went through the build."""
    return index.rows.select(id_column)


def term_grams(term: str) -> list[str]:
    return list(dict.fromkeys(term[i:i + GRAM] for i in range(len(term) - GRAM + 1)))


def candidates(index: GramIndex, id_column: str, columns: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """Ids that may hold a term: those with all its grams in one column.  A superset; the caller verifies."""
    rows = [(t, g, len(term_grams(t))) for t in terms for g in term_grams(t)]
    # one row per gram of a term given in the program
    wanted = literal_frame(index.postings.sparkSession, rows, [("term", "string"), ("gram", "string"), ("n_grams", "int")])
    in_scope = F.col("column_id").isin(list(columns)) & F.col("gram").isin(sorted({g for _, g, _ in rows}))
    found = index.postings.filter(in_scope).join(F.broadcast(wanted), "gram")
    key = ["term", "column_id", "segment"]
    dense = found.filter("bits IS NOT NULL").select(*key, "n_grams", F.rpad("bits", _BITMAP_BYTES, F.lit(b"\0")).alias("bits"))
    sparse = found.filter("bits IS NULL").select(*key, "gram", "n_grams", F.explode("places").alias("place")).groupBy(
        *key, "gram", "n_grams").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits")).drop("gram")
    every = dense.unionByName(sparse).groupBy(*key, "n_grams").agg(
        F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n")).filter("n = n_grams")
    marked = every.groupBy("segment").agg(F.bitmap_or_agg("bits").alias("bits")).filter(F.bitmap_count("bits") > 0)
    byte = F.conv(F.hex(F.substring("bits", F.shiftright("place", 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, place & 7) & 1") == 1
    return index.rows.join(marked, "segment").withColumn("_byte", byte).filter(bit).select(id_column)


def index_search(
    df: DataFrame, index: GramIndex, id_column: str, columns: Sequence[str], terms: Sequence[str], clean: bool = False,
) -> DataFrame:
    """The same ids as ``scan_search``, through the index.

    Terms shorter than a gram cannot use it and are scanned for.
    """
    folded = fold_terms(terms)
    long_terms = [t for t in folded if len(t) >= GRAM]
    short_terms = [t for t in folded if len(t) < GRAM]
    found = []
    if long_terms:
        narrow = df.select(id_column, *dict.fromkeys(c for c in columns if c != id_column))
        likely = reduced_semi_join(narrow, candidates(index, id_column, columns, long_terms), id_column)
        found.append(scan_search(likely, id_column, columns, long_terms, clean))
    if short_terms:
        found.append(scan_search(df, id_column, columns, short_terms, clean))
    return found[0] if len(found) == 1 else found[0].union(found[1]).distinct()
