"""Search, set algebra, and fetching candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.predicates import condition
from rollbook.operators import gram_index, idsets, lexical, selection
from rollbook.operators.numbering import number_rows
from rollbook.operators.statistics import distribution
from rollbook.queries.registry import query, table
from rollbook.session import scratch_path

PRIMARY = ["THER"]
EXPANDED = ["tion", "eaux"]
_PRIMARY_SQL = "contains(lower(text), 'ther')"
_EXPANDED_SQL = "(contains(lower(text), 'tion') OR contains(lower(text), 'eaux'))"
SEARCH_SQL = f"({_PRIMARY_SQL} OR {_EXPANDED_SQL})"


def _filtered(spark: SparkSession, folder: str) -> DataFrame:
    return selection.candidate_ids(table(spark, folder, "documents"), "doc_id", condition("lang", "eq", "en", "category"))


def _searched(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.scan_search(table(spark, folder, "documents"), "doc_id", ["text"], PRIMARY + EXPANDED)


def question(documents: DataFrame) -> DataFrame:
    """Filter and search in one scan, then the distribution of the hits by source."""
    keep = condition("lang", "in", ["en", "fr"], "category") & lexical.term_hit(["text"], PRIMARY + EXPANDED)
    return distribution(documents.filter(keep), "source")


@query("search_question", f"""
WITH hits AS (SELECT source FROM documents WHERE lang IN ('en', 'fr') AND {SEARCH_SQL})
SELECT source AS category, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM hits), 2) AS percentage
FROM hits GROUP BY source
""")
def search_question(spark: SparkSession, folder: str) -> DataFrame:
    return question(table(spark, folder, "documents"))


@query("lexical_scan", f"SELECT doc_id FROM documents WHERE {SEARCH_SQL}")
def lexical_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _searched(spark, folder)


@query("lexical_columns", """
SELECT page_id FROM pages WHERE contains(lower(url), 'example.org') OR contains(lower(html), 'example.org')
""")
def lexical_columns(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.scan_search(table(spark, folder, "pages"), "page_id", ["url", "html"], ["Example.ORG"])


_WIDE = {"plain": "abcdefghijklmnopqrstuvwxyz", "wide": "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"}


def _wide_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose urls are written in full-width letters and whose markup has every space doubled."""
    return table(spark, folder, "pages").select(
        "page_id", F.translate("url", _WIDE["plain"], _WIDE["wide"]).alias("url"), F.replace("html", F.lit(" "), F.lit("  ")).alias("html"))


@query("lexical_folded", """
SELECT page_id FROM pages WHERE contains(lower(url), 'example') OR contains(lower(html), 'of the')
""")
def lexical_folded(spark: SparkSession, folder: str) -> DataFrame:
    """Width and spacing differ between terms and texts, in both directions."""
    return lexical.scan_search(_wide_pages(spark, folder), "page_id", ["url", "html"], ["ＥＸＡＭＰＬＥ", "of   the"])


@query("lexical_folded_index", """
SELECT page_id FROM pages WHERE contains(lower(url), 'example') OR contains(lower(html), 'of the')
""")
def lexical_folded_index(spark: SparkSession, folder: str) -> DataFrame:
    """The same through a stored trigram index."""
    pages = _wide_pages(spark, folder)
    index = gram_index.write_index(pages, "page_id", ["url", "html"], scratch_path(spark, "wide-index"))
    return gram_index.index_search(pages, index, "page_id", ["url", "html"], ["ＥＸＡＭＰＬＥ", "of   the"])


@query("lexical_one_column", "SELECT page_id FROM pages WHERE contains(lower(url), '/en/') OR contains(lower(url), '/fr/')")
def lexical_one_column(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.scan_search(table(spark, folder, "pages"), "page_id", ["url"], ["/EN/", "/fr/"])


@query("lexical_expanded", f"""
SELECT doc_id, {_PRIMARY_SQL} AS hit_primary, {_EXPANDED_SQL} AS hit_expanded FROM documents WHERE {SEARCH_SQL}
""")
def lexical_expanded(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.expanded_search(table(spark, folder, "documents"), "doc_id", ["text"], PRIMARY, EXPANDED)


@query("trigram_index", """
WITH chars AS (SELECT doc_id, string_split(lower(text), '') AS c FROM documents),
grams AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(c) - 1, 1)), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS gram
  FROM chars)
SELECT 'text' AS column_id, gram, count(*) AS n_records FROM grams GROUP BY gram
UNION ALL SELECT 'text', '', count(*) FROM documents
""")
def trigram_index(spark: SparkSession, folder: str) -> DataFrame:
    """Every gram of the whole texts with its number of records; the empty gram counts them all."""
    documents = table(spark, folder, "documents")
    return gram_index.gram_frequencies(gram_index.write_index(documents, "doc_id", ["text"], scratch_path(spark, "gram-index")))


@query("lexical_trigram", f"SELECT doc_id FROM documents WHERE {SEARCH_SQL}")
def lexical_trigram(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of ``lexical_scan``, found through a stored index."""
    documents = table(spark, folder, "documents")
    index = gram_index.write_index(documents, "doc_id", ["text"], scratch_path(spark, "gram-index"))
    return gram_index.index_search(documents, index, "doc_id", ["text"], PRIMARY + EXPANDED)


@query("lexical_many_terms", f"""
WITH words AS (SELECT list(DISTINCT lower(w)) AS ws FROM (
  SELECT unnest(regexp_extract_all(text, '[A-Za-z]{{4,}}')) AS w FROM benchmark))
SELECT doc_id, {_PRIMARY_SQL} AS hit_primary, len(list_filter(ws, lambda w: contains(lower(text), w))) > 0 AS hit_expanded
FROM documents, words WHERE {_PRIMARY_SQL} OR len(list_filter(ws, lambda w: contains(lower(text), w))) > 0
""")
def lexical_many_terms(spark: SparkSession, folder: str) -> DataFrame:
    """All words of the benchmark as expanded terms: a list as long as the program's literals, in one pass over the texts."""
    words = table(spark, folder, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{4,})"), 1)).alias("w"))
    terms = [r["w"] for r in words.select(F.lower("w").alias("w")).distinct().collect()]
    return lexical.expanded_search(table(spark, folder, "documents"), "doc_id", ["text"], PRIMARY, terms)


@query("set_intersect", f"SELECT doc_id FROM documents WHERE lang = 'en' AND {SEARCH_SQL}")
def set_intersect(spark: SparkSession, folder: str) -> DataFrame:
    return selection.combine_ids(_filtered(spark, folder), _searched(spark, folder), "INTERSECT")


@query("set_union", f"SELECT doc_id FROM documents WHERE lang = 'en' OR {SEARCH_SQL}")
def set_union(spark: SparkSession, folder: str) -> DataFrame:
    return selection.combine_ids(_filtered(spark, folder), _searched(spark, folder), "UNION")


@query("set_except", f"SELECT doc_id FROM documents WHERE lang = 'en' AND NOT {SEARCH_SQL}")
def set_except(spark: SparkSession, folder: str) -> DataFrame:
    return selection.combine_ids(_filtered(spark, folder), _searched(spark, folder), "EXCEPT")


def _numbered_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return number_rows(lines, ["l_orderkey", "l_linenumber"], "row_no")


def _line_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Large lines, and returned ones."""
    kept = [condition("l_quantity", "gte", 30.0, "numeric"), condition("l_returnflag", "eq", "R", "status")]
    large, returned = (idsets.id_set(rows.filter(k), "row_no") for k in kept)
    return large, returned


def _line_set_query(operation: str):
    def build(spark: SparkSession, folder: str) -> DataFrame:
        rows = _numbered_lines(spark, folder)
        both = idsets.combine_sets(*_line_sets(rows), operation)
        return idsets.members(rows, "row_no", both).select("l_orderkey", "l_linenumber", "l_quantity")
    return build


_LINES_SQL = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE "
for _operation, _where in {
    "INTERSECT": "l_quantity >= 30 AND l_returnflag = 'R'", "UNION": "l_quantity >= 30 OR l_returnflag = 'R'",
    "EXCEPT": "l_quantity >= 30 AND l_returnflag <> 'R'",
}.items():
    query(f"set_{_operation.lower()}_bitmap", _LINES_SQL + _where)(_line_set_query(_operation))


@query("retrieval_trace_bitmap", """
SELECT count(*) FILTER (l_quantity >= 30) AS sql_matched_count, count(*) FILTER (l_returnflag = 'R') AS fts_matched_count,
  'EXCEPT' AS set_operation, count(*) FILTER (l_quantity >= 30 AND l_returnflag <> 'R') AS final_candidate_count FROM lineitem
""")
def retrieval_trace_bitmap(spark: SparkSession, folder: str) -> DataFrame:
    """Both sides counted from bitmaps, one row per 32,768 line numbers."""
    return idsets.set_trace(*_line_sets(_numbered_lines(spark, folder)), "EXCEPT")


@query("coverage_bitmap", """
WITH l AS (SELECT l_quantity >= 30 AS c, l_returnflag = 'R' AS e, l_linenumber = 1 AS f FROM lineitem)
SELECT count(*) FILTER (c) AS total_candidates, count(*) FILTER (e) AS evaluated_count, count(*) FILTER (f) AS failed_count,
  count(*) FILTER (c AND NOT e AND NOT f) AS skipped_count, count(*) FILTER (NOT c AND (e OR f)) AS outside_candidates,
  round(count(*) FILTER (e) * 100.0 / count(*) FILTER (c), 2) AS coverage_percentage, FALSE AS is_100_percent_covered FROM l
""")
def coverage_bitmap(spark: SparkSession, folder: str) -> DataFrame:
    """Large lines as candidates, returned ones as evaluated, first lines of orders as failed."""
    rows = _numbered_lines(spark, folder)
    large, returned = _line_sets(rows)
    return idsets.set_coverage(large, returned, idsets.id_set(rows.filter("l_linenumber = 1"), "row_no"))


_TRACE_SQL = f"""
SELECT count(*) FILTER (lang = 'en') AS sql_matched_count, count(*) FILTER ({SEARCH_SQL}) AS fts_matched_count,
  'INTERSECT' AS set_operation, count(*) FILTER (lang = 'en' AND {SEARCH_SQL}) AS final_candidate_count
FROM documents
"""


@query("retrieval_trace", _TRACE_SQL)
def retrieval_trace(spark: SparkSession, folder: str) -> DataFrame:
    return selection.retrieval_trace_one_table(
        table(spark, folder, "documents"), condition("lang", "eq", "en"), lexical.term_hit(["text"], PRIMARY + EXPANDED)
    )


@query("retrieval_trace_ids", _TRACE_SQL)
def retrieval_trace_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The same from two id frames that need not share a table."""
    return selection.retrieval_trace(_filtered(spark, folder), _searched(spark, folder), "doc_id")


@query("limit_candidates", """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100
""")
def limit_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """A report limit, applied in id order after the set algebra."""
    ids = selection.candidate_ids(table(spark, folder, "orders"), "o_orderkey", condition("o_orderstatus", "eq", "F"))
    return selection.limit_ids(ids, "o_orderkey", 100)


_HALF_SQL = """
SELECT {key} AS {name} FROM orders QUALIFY row_number() OVER (ORDER BY {key}) <= (SELECT count(*) // 2 FROM orders)
"""


@query("limit_half", _HALF_SQL.format(key="o_orderkey", name="o_orderkey"))
def limit_half(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the orders as limit."""
    orders = table(spark, folder, "orders")
    return selection.limit_ids(orders.select("o_orderkey"), "o_orderkey", orders.count() // 2)


@query("limit_half_text", _HALF_SQL.format(key="'REC-' || o_orderkey", name="record_id"))
def limit_half_text(spark: SparkSession, folder: str) -> DataFrame:
    """Half of them in the order of a text id."""
    orders = table(spark, folder, "orders")
    ids = orders.select(F.concat(F.lit("REC-"), F.col("o_orderkey").cast("string")).alias("record_id"))
    return selection.limit_ids(ids, "record_id", orders.count() // 2)


@query("restrict_to_candidates", """
SELECT o.* FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= 49.0)
""")
def restrict_to_candidates(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "lineitem").filter(condition("l_quantity", "gte", 49.0)).select(F.col("l_orderkey").alias("o_orderkey"))
    return selection.restrict(table(spark, folder, "orders"), ids, "o_orderkey")


@query("fetch_records", f"SELECT doc_id, source, text FROM documents WHERE lang = 'en' AND {SEARCH_SQL}")
def fetch_records(spark: SparkSession, folder: str) -> DataFrame:
    ids = selection.combine_ids(_filtered(spark, folder), _searched(spark, folder))
    return selection.fetch_records(table(spark, folder, "documents"), ids, "doc_id", ["source", "text"])


_JUDGED_SQL = """
SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'UNCERTAIN' WHEN l.quality = 1 THEN 'MATCH' ELSE 'NO_MATCH' END AS judgment,
  CASE WHEN l.doc_id IS NOT NULL THEN 'toxic=' || l.toxic END AS reason
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang = 'en'
"""


def _judgments(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(
        "doc_id",
        F.when(F.col("quality") == 1, "MATCH").when(F.col("quality") == 0, "NO_MATCH").otherwise("UNCERTAIN").alias("judgment"),
        F.concat(F.lit("toxic="), F.col("toxic").cast("string")).alias("reason"),
    )


@query("semantic_filter", f"SELECT doc_id, judgment, reason FROM ({_JUDGED_SQL}) WHERE judgment = 'MATCH'")
def semantic_filter(spark: SparkSession, folder: str) -> DataFrame:
    return selection.semantic_filter(_filtered(spark, folder), _judgments(spark, folder), "doc_id")


@query("semantic_filter_keep_uncertain", f"SELECT doc_id, judgment, coalesce(reason, '') AS reason FROM ({_JUDGED_SQL}) WHERE judgment <> 'NO_MATCH'")
def semantic_filter_keep_uncertain(spark: SparkSession, folder: str) -> DataFrame:
    kept = selection.semantic_filter(_filtered(spark, folder), _judgments(spark, folder), "doc_id", keep_uncertain=True)
    return kept.withColumn("reason", F.coalesce("reason", F.lit("")))
