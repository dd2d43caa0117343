"""Join of short strings by edit distance over length.

Two strings of which the longer has L characters share at least L + q - 1 - q * d of their grams when d edits apart:
runs of q characters, the ends marked, the copies of a run in one string told apart.  With q small enough for the wanted
similarity this is at least one, so strings meet on grams instead of all with all.  Each string posts only as
many of its rarest grams as it may miss, plus one.  What met is bounded from below by
shared grams and shared letters, and edit distances are computed for pairs that can still be the best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rollbook.operators.joins import spread_join
from rollbook.session import materialise

# Similarities are compared after rounding to four places.
ROUNDING = 5e-5
# Values with a name this near are done before the wide search begins.
NEAR_FIRST = 0.8
_START, _END = "\x02", "\x03"


def gram_size(min_similarity: float, longest: int) -> int:
    """The largest run of characters, three at most, of which similar strings share at least one."""
    part = 1 - min_similarity + ROUNDING
    return next((q for q in (3, 2) if longest * (1 - q * part) + q - 1 > 0), 1)


def _numbered(runs: Column) -> Column:
    """The runs, sorted, each with its number among equal ones."""
    start = F.struct(F.lit("").alias("run"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def add(state: Column, run: Column) -> Column:
        n = F.when(state["run"] == run, state["n"] + 1).otherwise(F.lit(1))
        return F.struct(run.alias("run"), n.alias("n"), F.concat(state["out"], F.array(F.concat(run, n.cast("string")))).alias("out"))

    return F.aggregate(F.array_sort(runs), start, add, lambda state: state["out"])


def _runs(text: Column, q: int) -> Column:
    marked = F.concat(F.lit(_START * (q - 1)), text, F.lit(_END * (q - 1)))
    return F.transform(F.sequence(F.lit(1), F.length(marked) - q + 1), lambda i: F.substring(marked, i, F.lit(q)))


def _described(strings: DataFrame, q: int) -> DataFrame:
    """``(text, size, letters, grams)`` of distinct strings that are not empty."""
    filled = strings.filter(F.length("text") > 0).select("text", F.length("text").alias("size"))
    return materialise(filled.select(
        "text", "size", _numbered(_runs(F.col("text"), 1)).alias("letters"), _numbered(_runs(F.col("text"), q)).alias("grams")), "strings")


def _posted(strings: DataFrame, frequency: DataFrame, q: int) -> DataFrame:
    """``(gram, text, size, place)``: each string's grams that any name has, counted from its rarest on."""
    grams = strings.select(F.explode("grams").alias("gram"), "text", "size").join(frequency, "gram", "left")
    order = W.partitionBy("text").orderBy(F.coalesce("n", F.lit(0)), "gram")
    placed = grams.withColumn("place", F.row_number().over(order))
    return placed.filter("n IS NOT NULL").select("gram", "text", "size", "place")


def _prefix(posted: DataFrame, q: int, similarity: float) -> DataFrame:
    """The grams that a string must post at a similarity."""
    part = 1 - similarity + ROUNDING
    # what it shares at least with a partner of its own length or longer
    share = F.greatest(F.lit(1), F.ceil(F.col("size") * (1 - q * part) + q - 1)) if 1 - q * part >= 0 else F.lit(1)
    return posted.filter(F.col("place") <= F.col("size") + q - share).drop("place")


def _met(values: DataFrame, names: DataFrame, posted: tuple[DataFrame, DataFrame], q: int, similarity: float) -> DataFrame:
    """``(text, name, longer, least)``: pairs that may reach the similarity, with a lower bound of their distance."""
    part = 1 - similarity + ROUNDING
    left, right = (_prefix(p, q, similarity) for p in posted)
    right = right.select("gram", F.col("text").alias("name"), F.col("size").alias("name_size"))
    near = F.least("size", "name_size") >= F.greatest("size", "name_size") * (1 - part)
    pairs = spread_join(left, right, ["gram"], ["text"], "inner").filter(near).select("text", "name").distinct()
    other = names.select(F.col("text").alias("name"), F.col("size").alias("_size"), F.col("letters").alias("_letters"), F.col("grams").alias("_grams"))
    longer = F.greatest("size", "_size")
    by_letters = longer - F.size(F.array_intersect("letters", "_letters"))
    by_grams = F.ceil((longer + q - 1 - F.size(F.array_intersect("grams", "_grams"))) / q)
    bounded = pairs.join(values, "text").join(other, "name").select(
        "text", "name", longer.alias("longer"), F.greatest(by_letters, by_grams).cast("int").alias("least"))
    return bounded.filter(F.col("least") <= F.col("longer") * part)


def _best(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("text").agg(F.min(F.struct("distance", "name")).alias("best")).select("text", "best.distance", "best.name")


def _nearest(met: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The nearest name of each value among stored pairs that met, and the pairs whose distance was computed.

    The pair with the best bound is measured first; of the others only those that can come as near.
    """
    part = F.lit(1 - similarity + ROUNDING)
    promise = F.col("least") / F.col("longer")
    first = met.groupBy("text").agg(F.min(F.struct(promise.alias("promise"), "name", "longer")).alias("first")).select("text", "first.*")
    measured = materialise(first.select("text", "name", (F.levenshtein("text", "name") / F.col("longer")).alias("distance")), "first")
    reached = measured.select("text", F.col("name").alias("first_name"), F.least("distance", part).alias("reached"))
    rest = met.join(reached, "text").filter((promise <= F.col("reached")) & (F.col("name") != F.col("first_name")))
    # beyond the threshold the function stops early and gives -1
    most = F.floor(F.col("reached") * F.col("longer")).cast("int")
    edits = rest.withColumn("_most", most).withColumn("_edits", F.expr("levenshtein(text, name, _most)"))
    others = materialise(edits.select("text", "name", F.when(F.col("_edits") >= 0, F.col("_edits") / F.col("longer")).alias("distance")), "others")
    compared = measured.unionByName(others)
    found = compared.filter(F.round(F.lit(1.0) - F.col("distance"), 4) >= similarity)
    return materialise(_best(found), "nearest"), compared


def nearest_names(values: DataFrame, names: DataFrame, min_similarity: float) -> tuple[DataFrame, DataFrame]:
    """``(text, distance, name)`` for stored, distinct texts: the name at the smallest distance over length, then the first in order.

    Texts without a name of the wanted similarity are left out.  The second frame holds the pairs that were measured.
    """
    longest = max(side.agg(F.coalesce(F.max(F.length("text")), F.lit(0))).first()[0] for side in (values, names))
    q = gram_size(min_similarity, longest)
    names = _described(names, q)
    values = _described(values, q)
    frequency = names.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    posted = tuple(materialise(_posted(side, frequency, q), "posted") for side in (values, names))
    found = compared = None
    for similarity in sorted({max(NEAR_FIRST, min_similarity), min_similarity}, reverse=True):
        open_values, open_posted = values, posted[0]
        if found is not None:
            open_values, open_posted = (side.join(found.select("text"), "text", "left_anti") for side in (values, posted[0]))
        met = materialise(_met(open_values, names, (open_posted, posted[1]), q, similarity), "met")
        nearest, pairs = _nearest(met, similarity)
        found = nearest if found is None else found.unionByName(nearest)
        compared = pairs if compared is None else compared.unionByName(pairs)
    return found, compared
