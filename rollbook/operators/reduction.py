"""Semi joins that shuffle the likely rows of a wide table only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.operators.joins import BROADCAST_BYTES_MAX, fits_broadcast
from rollbook.session import materialise

# Places of the filter per id: one in so many other rows passes.
PLACES_PER_ID = 64
# One row of the filter is one of Spark's bitmaps.
_BUCKET_PLACES = 1 << 15
_BUCKET_BYTES = _BUCKET_PLACES // 8


def filter_buckets(n_ids: int) -> int:
    """Bitmaps for so many ids, whatever their number."""
    return max(1, -(-n_ids * PLACES_PER_ID // _BUCKET_PLACES))


def _place(id_column: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_column), F.lit(buckets * _BUCKET_PLACES)) + 1


def id_filter(ids: DataFrame, id_column: str, n_ids: int) -> DataFrame:
    """``(_bucket, _bits)``: a bitmap over hashes of the ids, sized from their count."""
    place = _place(id_column, filter_buckets(n_ids))
    return ids.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))


def bit_is_set(bits: str, bit: Column) -> Column:
    """Whether a bitmap column holds a place."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8 + 1).cast("int"))
    return byte.bitwiseAND(mask) != 0


def likely_rows(df: DataFrame, marks: DataFrame, id_column: str, buckets: int) -> DataFrame:
    """The rows whose id may be one of those in the filter; the filter is sent to all tasks."""
    place = _place(id_column, buckets)
    marked = df.withColumns({"_bucket": F.bitmap_bucket_number(place), "_bit": F.bitmap_bit_position(place)})
    return marked.join(F.broadcast(marks), "_bucket").filter(bit_is_set("_bits", F.col("_bit"))).select(*df.columns)


def reduced_semi_join(df: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """``df`` restricted to the ids, for wide rows and ids that are few against them.

    The ids are stored and counted.  Few are sent to all tasks, and nothing of ``df`` is shuffled; more make a filter
    of ``PLACES_PER_ID`` places each, so that of the other rows one in as many is shuffled.  Ids too many even for
    the filter's broadcast bound meet in a plain semi join.  NULL ids never match.
    """
    ids = materialise(ids.select(id_column).filter(F.col(id_column).isNotNull()).distinct(), "ids")
    n, width = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(id_column).cast("string"))), F.lit(0))).first()
    if fits_broadcast(n, width):
        return df.join(F.broadcast(ids), id_column, "left_semi")
    buckets = filter_buckets(n)
    if buckets * _BUCKET_BYTES <= BROADCAST_BYTES_MAX:
        df = likely_rows(df, id_filter(ids, id_column, n), id_column, buckets)
    return df.join(ids, id_column, "left_semi")
