"""Reading registers and findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.fixed import HEADER_IDS
from rollbook.operators.evidence import KEY, apply_defaults
from rollbook.operators.joins import fits_broadcast, spread_join
from rollbook.session import materialise

# Read back exactly what was written: quotes doubled, spaces kept, an empty
# field NULL and a quoted empty field the empty string (which takes a NULL mark
# that no field holds).
CSV_OPTIONS = {
    "quote": '"', "escape": '"', "multiLine": True, "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "maxCharsPerColumn": -1,
    "nullValue": "\x00null\x00",
}

# Hex digits of the hash in made ids: 64 bits.
ID_DIGITS = 16
# Different header rows that one register's files may have.
LAYOUTS_MAX = 100
FINGERPRINT_BLOCKS = 4096

FINDING_FIELDS = (
    "finding_id string, type string, finding_type string, claim string, supporting_records array<string>, "
    "counter_records array<string>, confidence string, confidence_reason string, hypotheses array<string>, derived_batch_ids array<string>"
)


def column_id(header: str) -> str:
    """The column id of a source header: the known name, else the header made a plain name."""
    header = header.strip().lstrip("﻿")
    if header in HEADER_IDS:
        return HEADER_IDS[header]
    plain = "".join(ch if ch.isalnum() or ch == "_" else "_" for ch in header)
    return f"col_{plain}" if plain[:1].isdigit() else plain


def read_register(
    spark: SparkSession, path: str, headers: Sequence[str] | None = None, header_row: int = 1, id_header: str | None = None,
    multi_line: bool = True, id_digits: int = ID_DIGITS,
) -> DataFrame:
    """A CSV register as the raw table: record_id, source_file, row_idx and ``<column>_raw`` strings.

    Values stay verbatim.  ``row_idx`` is the row's place in its file, the
    header row counted, so rows after a first-line header start at 2.  Without
    ``headers`` the names come from the header row of the first file.  A file whose header row
    names the same columns in another order is read by its own names; one that names
    others is refused, unless ``headers`` rename the columns of all files alike.  With
    ``multi_line`` off, for registers without line breaks inside values, large
    files are read in parallel splits; otherwise a file is one task.
    """
    options = {**CSV_OPTIONS, "multiLine": multi_line}
    named = headers is not None
    if headers is None:
        if header_row != 1:
            raise ValueError("give the headers when they are not in the first row")
        headers = spark.read.options(**options).option("header", True).csv(path).columns
    ids = [column_id(h) for h in headers]
    if len(set(ids)) < len(ids):
        raise ValueError(f"headers give repeated column ids: {ids}")
    schema = T.StructType([T.StructField(f"{c}_raw", T.StringType()) for c in ids])
    rows = (
        spark.read.schema(schema).options(**options).option("header", False).csv(path)
        .select(
            "*",
            F.col("_metadata.file_name").alias("source_file"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_split"),
            F.monotonically_increasing_id().alias("_seen"),
        )
    )
    placed = materialise(rows)
    # a file's rows keep their order within a split; add up the splits before
    splits = placed.groupBy("_file", "_split").agg(F.min("_seen").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy("_file").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)
    offsets = materialise(splits.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows"))
    if fits_broadcast(offsets.count(), 0):
        joined = placed.join(F.broadcast(offsets), ["_file", "_split"])
    else:
        joined = spread_join(placed, offsets, ["_file", "_split"], ["_seen"], "inner")
    numbered = joined.withColumn(
        "row_idx", F.col("_before") + F.col("_seen") - F.col("_first") + 1
    )
    if header_row:
        numbered = _aligned(numbered, [f"{c}_raw" for c in ids], header_row, named)
    numbered = numbered.filter(F.col("row_idx") > header_row)
    return assign_record_id(numbered, f"{column_id(id_header)}_raw" if id_header else None, [f"{c}_raw" for c in ids], digits=id_digits)


def _aligned(rows: DataFrame, columns: Sequence[str], header_row: int, named: bool) -> DataFrame:
    """The rows with each file's values under its own header names.

    Header rows are compared in Spark; only the differing layouts reach the driver, once each.
    """
    cells = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in columns])
    headers = rows.filter(F.col("row_idx") == header_row).select("_file", cells.alias("_cells"))
    layouts = [list(r[0]) for r in headers.select("_cells").distinct().limit(LAYOUTS_MAX + 1).collect()]
    if len(layouts) > LAYOUTS_MAX:
        raise ValueError(f"more than {LAYOUTS_MAX} different header rows")
    orders = {}
    for layout in layouts:
        found = [f"{column_id(h)}_raw" for h in layout]
        if sorted(found) == sorted(columns):
            orders[tuple(layout)] = [found.index(c) for c in columns]
        elif not named or len(layouts) > 1:
            raise ValueError(f"a file's header row {layout} does not name the columns {list(columns)}")
    others = {k: v for k, v in orders.items() if v != list(range(len(columns)))}
    if not others:
        return rows
    chosen = F.lit(0)
    for number, layout in enumerate(others, 1):
        chosen = F.when(F.col("_cells") == F.array(*[F.lit(h) for h in layout]), number).otherwise(chosen)
    by_file = materialise(headers.select("_file", chosen.alias("_layout")))
    if fits_broadcast(by_file.count(), 0):
        joined = rows.join(F.broadcast(by_file), "_file", "left")
    else:
        joined = spread_join(rows, by_file, ["_file"], ["_seen"], "left")
    picked = {}
    for at, column in enumerate(columns):
        value = F.col(column)
        for number, order in enumerate(others.values(), 1):
            value = F.when(F.col("_layout") == number, F.col(columns[order[at]])).otherwise(value)
        picked[column] = value
    return joined.withColumns(picked).drop("_layout")


def assign_record_id(
    df: DataFrame, id_column: str | None, content_columns: Sequence[str], order: str = "row_idx", digits: int = ID_DIGITS,
) -> DataFrame:
    """Add ``record_id``: the named column, else one made from row number, content and source file.

    The made id depends on the row alone, so reading again gives the same ids.
    Row numbers repeat over files, so ``digits`` of the hash keep ids apart; fewer
    suit a single file.  The build check reports ids that occur twice.
    """
    if id_column is not None:
        record_id = F.col(id_column).cast("string")
    else:
        hashed = [*content_columns, *(c for c in ("source_file",) if c in df.columns)]
        content = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in hashed])
        record_id = F.concat(
            F.lit("REC-"),
            F.when(F.length(F.col(order).cast("string")) >= 4, F.col(order).cast("string"))
            .otherwise(F.lpad(F.col(order).cast("string"), 4, "0")),
            F.lit("-"),
            F.substring(F.sha2(content, 256), 1, digits),
        )
    out = df.withColumn("record_id", record_id)
    if "source_file" in df.columns:
        return out.select("record_id", "source_file", order, *content_columns)
    return out


def raw_view(df: DataFrame, id_column: str, columns: Sequence[str], source_file: str, order: str) -> DataFrame:
    """Any table with a unique id and integer row number as a raw register."""
    return df.select(
        F.col(id_column).cast("string").alias("record_id"),
        F.lit(source_file).alias("source_file"),
        F.col(order).cast("long").alias("row_idx"),
        *[F.col(c).cast("string").alias(f"{c}_raw") for c in columns],
    )


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of a row's values, NULL told apart from the empty string."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def row_fingerprints(df: DataFrame, id_column: str, columns: Sequence[str]) -> DataFrame:
    """The digest of each row."""
    return df.select(id_column, row_digest(columns).alias("sha256"))


def table_fingerprint(df: DataFrame, columns: Sequence[str], blocks: int = FINGERPRINT_BLOCKS) -> DataFrame:
    """``(n_rows, sha256)``: one digest of a table of any size, whatever the order of its rows.

    Row digests are dealt into blocks by their first digits.  A block's digest covers the sum and count of
    each distinct row's digest parts, so repeated rows count, and the table's digest covers the blocks in order.
    """
    rows = row_fingerprints(df.withColumn("_row", F.lit(0)), "_row", columns)
    block = F.conv(F.substring("sha256", 1, 8), 16, 10).cast("long") % blocks
    part = [F.conv(F.substring("sha256", at, 12), 16, 10).cast("decimal(38,0)") for at in (9, 21, 33, 45)]
    sums = rows.groupBy(block.alias("block")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(part)])
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in ("block", "n", "s0", "s1", "s2", "s3")])
    listed = F.transform(F.sort_array(F.collect_list(F.struct("block", text.alias("t")))), lambda x: x.t)
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.sha2(F.concat_ws("|", listed), 256).alias("sha256"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each source file's bytes, for files up to 2 GB; ``table_fingerprint`` has no such bound."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("source_file"), "length", F.sha2("content", 256).alias("sha256")
    )


def parse_findings(documents: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Findings from JSON text: a list, or an object with a ``findings`` list; defaults filled in.

    Positions count from 1 within each document, so ids made from them repeat over documents.  ``keep`` names
    columns to carry along, which tell the documents apart: ``finding_key`` is made of them and the position.
    """
    strict = {"mode": "FAILFAST"}
    as_list = F.from_json(F.col(text), f"array<struct<{_struct(FINDING_FIELDS)}>>", strict)
    as_object = F.from_json(F.col(text), f"struct<findings: array<struct<{_struct(FINDING_FIELDS)}>>>", strict)["findings"]
    is_list = F.col(text).rlike(r"^\s*\[")
    items = documents.select(*keep, F.posexplode(F.when(is_list, as_list).otherwise(as_object)).alias("_at", "f"))
    place = (F.col("_at") + 1).cast("string")
    key = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keep], place)
    return apply_defaults(items.select(*keep, key.alias(KEY), (F.col("_at") + 1).alias("position"), "f.*"), "position")


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings files, one JSON document each; a document is one row."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_path"))
    return parse_findings(files, "value", keep=["source_path"])


def _struct(fields: str) -> str:
    return ", ".join(": ".join(f.strip().split(" ", 1)) for f in fields.split(", "))
