"""Reading, cleaning, profiling and normalising whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.text import clean_text as clean
from rollbook.functions.text import search_shadow as shadow
from rollbook.operators import normalization as nz
from rollbook.operators import profiling
from rollbook.operators.gram_index import indexed_ids, write_index
from rollbook.operators.numbering import number_rows
from rollbook.operators.validation import validate_build as check_build
from rollbook.queries.filters import PRIORITIES, PRIORITY_SQL, orders_by_priority
from rollbook.queries.registry import query, table
from rollbook.session import materialise, scratch_path
from rollbook.sources import digests, register, sinks

# Dictionaries over the given tables.
EVENTS = [
    ("event_view", "view", 10, ["page view"]),
    ("event_click", "click", 20, ["tap"]),
    ("event_purchase", "order", 30, ["purchase", "buy"]),
]
TOOLS = [
    ("tool_ring", "red ring", 10, ["small rings"]),
    ("tool_bolt", "blue bolts", 20, ["bolt"]),
    ("tool_widget", "widget", 30, ["green widget", "large widgets"]),
]


@query("scan_register", """
SELECT CAST(page_id AS VARCHAR) AS record_id, CAST(page_id AS VARCHAR) AS page_id_raw, url AS url_raw, html AS html_raw,
  TRUE AS from_file, TRUE AS numbered FROM pages
""")
def scan_register(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as CSV files of two column orders and read back verbatim, markup and all.

    ``numbered`` says that the row numbers of the record's file run from 2 without gap or repeat.
    """
    path = scratch_path(spark, "pages-csv")
    pages = table(spark, folder, "pages")
    even = F.col("page_id") % 2 == 0
    sinks.write_csv(pages.filter(even).select("page_id", "url", "html"), f"{path}/even")
    sinks.write_csv(pages.filter(~even).select("html", "page_id", "url"), f"{path}/odd")
    raw = materialise(register.read_register(spark, f"{path}/*", ["page_id", "url", "html"], id_header="page_id"))
    rows = raw.groupBy("source_file").agg(
        ((F.min("row_idx") == 2) & (F.max("row_idx") == F.count("row_idx") + 1) & (F.count_distinct("row_idx") == F.count("row_idx")))
        .alias("numbered"))
    return raw.join(rows, "source_file").select(
        "record_id", "page_id_raw", "url_raw", "html_raw", F.col("source_file").endswith(".csv").alias("from_file"), "numbered")


@query("assign_record_id", """
SELECT 'REC-' || CASE WHEN doc_id > 9999 THEN CAST(doc_id AS VARCHAR) ELSE lpad(CAST(doc_id AS VARCHAR), 4, '0') END
  || '-' || left(sha256(text || chr(31) || lang || chr(31) || source), 4) AS record_id, doc_id
FROM documents
""")
def assign_record_id(spark: SparkSession, folder: str) -> DataFrame:
    """Made ids with the short hash that suits one file."""
    named = register.assign_record_id(table(spark, folder, "documents"), None, ["text", "lang", "source"], order="doc_id", digits=4)
    return named.select("record_id", "doc_id")


@query("assign_record_id_many_files", """
SELECT 'REC-' || CASE WHEN l_linenumber > 9999 THEN CAST(l_linenumber AS VARCHAR) ELSE lpad(CAST(l_linenumber AS VARCHAR), 4, '0') END
  || '-' || left(sha256(l_orderkey || chr(31) || l_partkey || chr(31) || l_suppkey), 16) AS record_id, l_orderkey, l_linenumber
FROM lineitem
""")
def assign_record_id_many_files(spark: SparkSession, folder: str) -> DataFrame:
    """Row numbers that repeat, as over many files: the hash keeps the ids apart."""
    lines = table(spark, folder, "lineitem")
    named = register.assign_record_id(lines, None, ["l_orderkey", "l_partkey", "l_suppkey"], order="l_linenumber")
    return named.select("record_id", "l_orderkey", "l_linenumber")


_PART_FINGERPRINT = "sha256(" + " || '|=' || ".join(
    ["'=' || p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]) + ")"


@query("row_fingerprint", f"SELECT p_partkey, {_PART_FINGERPRINT} AS sha256 FROM part")
def row_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return register.row_fingerprints(table(spark, folder, "part"), "p_partkey", _PART_COLUMNS)


@query("table_fingerprint", f"""
WITH r AS (SELECT {_PART_FINGERPRINT} AS h FROM part),
b AS (
  SELECT ('0x' || substr(h, 1, 8))::BIGINT % 4096 AS block, count(*) AS n,
    {", ".join(f"sum(('0x' || substr(h, {at}, 12))::BIGINT)::HUGEINT AS s{i}" for i, at in enumerate((9, 21, 33, 45)))}
  FROM r GROUP BY block)
SELECT sum(n)::BIGINT AS n_rows, sha256(string_agg(concat_ws(':', block, n, s0, s1, s2, s3), '|' ORDER BY block)) AS sha256 FROM b
""")
def table_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """One digest of all parts, whatever their order."""
    return register.table_fingerprint(table(spark, folder, "part"), _PART_COLUMNS)


_CLEAN_SQL = r"""nullif(trim(regexp_replace(regexp_replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'),
  ' ?\n ?', chr(10), 'g'), ' ' || chr(10)), '')"""


@query("clean_text", f"SELECT doc_id, {_CLEAN_SQL.format(c='text')} AS text FROM documents")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", clean(F.col("text")).alias("text"))


@query("search_shadow", f"""
SELECT page_id, lower({_CLEAN_SQL.format(c='url')}) AS url, lower({_CLEAN_SQL.format(c='nfc_normalize(html)')}) AS html FROM pages
""")
def search_shadow(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return pages.select("page_id", shadow(F.col("url")).alias("url"), shadow(F.col("html")).alias("html"))


def _profile_sql(table_name: str, columns: list[str]) -> str:
    date = r"""regexp_full_match(v, '[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}([ T].*)?')
      AND try_cast(replace(split_part(split_part(v, ' ', 1), 'T', 1), '/', '-') AS DATE) IS NOT NULL"""
    number = r"regexp_full_match(v, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')"
    return " UNION ALL ".join(f"""
SELECT '{c}' AS column_id, count(*) AS n_records, count(*) - count(v) AS null_count,
  (count(*) - count(v))::DOUBLE / count(*) AS null_ratio, count(DISTINCT v) AS distinct_count, count(DISTINCT v)::DOUBLE / count(*) AS distinct_ratio,
  coalesce(min(length(v)), 0) AS min_len, coalesce(max(length(v)), 0) AS max_len, sum(length(v))::DOUBLE / count(v) AS avg_len,
  count(*) FILTER ({date})::DOUBLE / count(v) AS date_ratio, count(*) FILTER ({number})::DOUBLE / count(v) AS number_ratio
FROM (SELECT nullif(CAST({c} AS VARCHAR), '') AS v FROM {table_name})""" for c in columns)


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@query("profile_columns", _profile_sql("orders", _ORDER_COLUMNS))
def profile_columns(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.profile_columns(table(spark, folder, "orders"), _ORDER_COLUMNS)


@query("profile_columns_part", _profile_sql("part", _PART_COLUMNS))
def profile_columns_part(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.profile_columns(table(spark, folder, "part"), _PART_COLUMNS)


_ROLES_SQL = f"""
SELECT column_id, CASE
  WHEN regexp_matches(column_id, '_id|id_|key|番号') AND distinct_ratio >= 0.95 THEN 'record_id'
  WHEN regexp_matches(column_id, 'phase|stage|priority|工程|フェーズ') THEN 'ordered_category'
  WHEN regexp_matches(column_id, 'title|summary|subject|name|url|件名|タイトル') THEN 'short_text'
  WHEN regexp_matches(column_id, 'cause|text|html|description|countermeasure|comment|原因|対策|内容') THEN 'long_text'
  WHEN regexp_matches(column_id, 'status|state|状態') AND distinct_count <= 50 THEN 'status'
  WHEN date_ratio >= 0.8 THEN 'date' WHEN number_ratio >= 0.8 THEN 'numeric' WHEN distinct_count <= 50 THEN 'category'
  WHEN avg_len >= 60.0 THEN 'long_text' ELSE 'short_text' END AS role
FROM ({_profile_sql('orders', _ORDER_COLUMNS)} UNION ALL {_profile_sql('part', _PART_COLUMNS)}
  UNION ALL {_profile_sql('documents', _DOCUMENT_COLUMNS)})
"""


def _roles(spark: SparkSession, folder: str) -> DataFrame:
    profiles = [
        profiling.profile_columns(table(spark, folder, name), columns)
        for name, columns in (("orders", _ORDER_COLUMNS), ("part", _PART_COLUMNS), ("documents", _DOCUMENT_COLUMNS))
    ]
    return profiling.infer_roles(profiles[0].unionByName(profiles[1]).unionByName(profiles[2]))


@query("infer_roles", _ROLES_SQL)
def infer_roles(spark: SparkSession, folder: str) -> DataFrame:
    return _roles(spark, folder).select("column_id", "role")


@query("catalog_capabilities", f"""
SELECT column_id, role, role <> 'long_text' AS filterable, role IN ('record_id', 'short_text', 'long_text') AS searchable,
  role IN ('date', 'category', 'ordered_category', 'status') AS aggregatable,
  role IN ('category', 'ordered_category', 'status') AS normalizable, role IN ('date', 'numeric', 'ordered_category') AS ordered
FROM ({_ROLES_SQL})
""")
def catalog_capabilities(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.catalog(_roles(spark, folder))


@query("dictionary_resolve", f"""
SELECT o_orderpriority AS raw_value, count(*) AS n_records, any_value(id) AS canonical_id, any_value(label) AS canonical_label,
  any_value(ordinal) AS ordinal
FROM orders JOIN {PRIORITY_SQL} ON o_orderpriority = label GROUP BY o_orderpriority
""")
def dictionary_resolve(spark: SparkSession, folder: str) -> DataFrame:
    counts = nz.value_counts(table(spark, folder, "orders"), ["o_orderpriority"]).drop("column_id")
    return nz.resolve(counts, "raw_value", PRIORITIES)


_EVENT_SQL = """(VALUES ('view', 'event_view', 'view', 10), ('page view', 'event_view', 'view', 10), ('click', 'event_click', 'click', 20),
  ('tap', 'event_click', 'click', 20), ('order', 'event_purchase', 'order', 30), ('purchase', 'event_purchase', 'order', 30),
  ('buy', 'event_purchase', 'order', 30)) AS d(alias, id, label, ordinal)"""
_NAMES_SQL = """
SELECT p_name AS label, 'name_' || dense_rank() OVER (ORDER BY p_name) AS id, dense_rank() OVER (ORDER BY p_name) AS ordinal
FROM (SELECT DISTINCT p_name FROM part)
"""


def _name_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Every part name as a dictionary item, its words in capitals an alias: a dictionary that grows with the data."""
    names = table(spark, folder, "part").select(F.col("p_name").alias("label")).distinct()
    return number_rows(names, ["label"], "ordinal").select(
        F.concat(F.lit("name_"), "ordinal").alias("canonical_id"), "label", F.col("ordinal").cast("int").alias("ordinal"),
        F.array(F.concat(F.lit("No. "), F.upper("label"))).alias("aliases"))


@query("dictionary_resolve_table", f"""
SELECT p_partkey, 'no.  ' || p_name AS named, id AS canonical_id, label AS canonical_label, CAST(ordinal AS INT) AS ordinal
FROM part JOIN ({_NAMES_SQL}) ON label = p_name
""")
def dictionary_resolve_table(spark: SparkSession, folder: str) -> DataFrame:
    """Parts named by an alias of a dictionary kept in a table."""
    parts = table(spark, folder, "part").select("p_partkey", F.concat(F.lit("no.  "), "p_name").alias("named"))
    return nz.resolve(parts, "named", _name_dictionary(spark, folder))


@query("similar_values_table", f"""
WITH names AS ({_NAMES_SQL}), vals AS (SELECT p_brand || ' ' || p_name AS raw_value, count(*) AS n_records FROM part GROUP BY ALL),
forms AS (SELECT lower(label) AS name, id, label FROM names UNION ALL SELECT 'no. ' || lower(label), id, label FROM names),
scored AS (
  SELECT *, levenshtein(lower(raw_value), name)::DOUBLE / greatest(length(raw_value), length(name)) AS distance FROM vals, forms),
best AS (SELECT *, row_number() OVER (PARTITION BY raw_value ORDER BY distance, name) AS rn FROM scored)
SELECT raw_value, n_records, name AS similar_name, id AS canonical_id, label AS canonical_label, round(1.0 - distance, 4) AS similarity
FROM best WHERE rn = 1 AND round(1.0 - distance, 4) >= 0.5
""")
def similar_values_table(spark: SparkSession, folder: str) -> DataFrame:
    """Brand and name against all names, the dictionary in a table."""
    values = table(spark, folder, "part").select(F.concat_ws(" ", "p_brand", "p_name").alias("raw_value"))
    counts = values.groupBy("raw_value").agg(F.count(F.lit(1)).alias("n_records"))
    return nz.similar_values(counts, "raw_value", _name_dictionary(spark, folder), 0.5)


_CANDIDATE_SQL = f"""
SELECT 'event_type' AS column_id, event_type AS raw_value, coalesce(any_value(id), 'val_' || lower(event_type)) AS canonical_id,
  coalesce(any_value(label), event_type) AS canonical_label, coalesce(any_value(ordinal), 0) AS ordinal,
  CASE WHEN any_value(id) IS NULL THEN 'pending' ELSE 'accepted' END AS status,
  CASE WHEN any_value(id) IS NULL THEN 'low' ELSE 'high' END AS confidence,
  CASE WHEN any_value(id) IS NULL THEN 'unknown_value' ELSE 'dictionary_match' END AS source,
  CASE WHEN any_value(id) IS NULL THEN 'Unmatched distinct category value'
    ELSE 'Matched known dictionary alias for ''' || any_value(label) || '''' END AS reason,
  count(*) AS n_records
FROM events LEFT JOIN {_EVENT_SQL} ON lower(event_type) = alias WHERE event_type <> '' GROUP BY event_type
"""


def _event_mappings(spark: SparkSession, folder: str) -> DataFrame:
    return nz.propose_mappings(nz.value_counts(table(spark, folder, "events"), ["event_type"]), {"event_type": EVENTS})


@query("normalize_candidates", _CANDIDATE_SQL)
def normalize_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _event_mappings(spark, folder).withColumn("ordinal", F.coalesce("ordinal", F.lit(0)))


@query("review_queue", """
SELECT column_id, raw_value, n_records FROM (
  SELECT 'p_brand' AS column_id, p_brand AS raw_value, count(*) AS n_records FROM part GROUP BY p_brand
  UNION ALL SELECT 'p_name', p_name, count(*) FROM part GROUP BY p_name)
WHERE NOT (column_id = 'p_name' AND lower(raw_value) IN
  ('red ring', 'small rings', 'blue bolts', 'bolt', 'widget', 'green widget', 'large widgets'))
""")
def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    counts = nz.value_counts(table(spark, folder, "part"), ["p_brand", "p_name"])
    return nz.review_queue(nz.propose_mappings(counts, {"p_name": TOOLS}))


@query("similar_values", """
WITH names AS (SELECT * FROM (VALUES ('red ring', 'tool_ring', 'red ring'), ('small rings', 'tool_ring', 'red ring'),
  ('blue bolts', 'tool_bolt', 'blue bolts'), ('bolt', 'tool_bolt', 'blue bolts'), ('widget', 'tool_widget', 'widget'),
  ('green widget', 'tool_widget', 'widget'), ('large widgets', 'tool_widget', 'widget')) AS d(name, id, label)),
vals AS (SELECT p_name AS raw_value, count(*) AS n_records FROM part GROUP BY p_name),
scored AS (
  SELECT *, levenshtein(lower(raw_value), name)::DOUBLE / greatest(length(raw_value), length(name)) AS distance FROM vals, names),
best AS (SELECT *, row_number() OVER (PARTITION BY raw_value ORDER BY distance, name) AS rn FROM scored)
SELECT raw_value, n_records, name AS similar_name, id AS canonical_id, label AS canonical_label, round(1.0 - distance, 4) AS similarity
FROM best WHERE rn = 1 AND round(1.0 - distance, 4) >= 0.5
""")
def similar_values(spark: SparkSession, folder: str) -> DataFrame:
    counts = nz.value_counts(table(spark, folder, "part"), ["p_name"]).drop("column_id")
    return nz.similar_values(counts, "raw_value", TOOLS, 0.5)


@query("apply_normalization", f"""
SELECT o_orderkey, id AS o_orderpriority, label AS o_orderpriority_label, ordinal AS o_orderpriority_ordinal
FROM orders JOIN {PRIORITY_SQL} ON o_orderpriority = label
""")
def apply_normalization(spark: SparkSession, folder: str) -> DataFrame:
    return orders_by_priority(spark, folder).select(
        "o_orderkey", "o_orderpriority", "o_orderpriority_label", "o_orderpriority_ordinal"
    )


@query("apply_normalization_events", f"""
SELECT event_id, coalesce(id, 'val_' || lower(event_type)) AS event_type, coalesce(label, event_type) AS event_type_label,
  coalesce(ordinal, 0) AS event_type_ordinal
FROM events LEFT JOIN {_EVENT_SQL} ON lower(event_type) = alias
""")
def apply_normalization_events(spark: SparkSession, folder: str) -> DataFrame:
    """Proposed map, stored, pending entries accepted, then applied to every event."""
    mappings = sinks.write_table(nz.accept_pending(_event_mappings(spark, folder)), scratch_path(spark, "event-map"))
    events = table(spark, folder, "events").select("event_id", "event_type")
    return nz.apply_mappings(events, ["event_type"], mappings, "event_id").withColumn(
        "event_type_ordinal", F.coalesce("event_type_ordinal", F.lit(0))
    )


@query("validate_build", """
SELECT 'INFO' AS severity, 'fts' AS category, 'FTS index verified: ' || count(*) || ' records cleanly indexed.' AS message
FROM documents
UNION ALL SELECT 'INFO', 'structure', 'Total records verified: ' || count(*) || ', total columns: 5' FROM documents
""")
def validate_build(spark: SparkSession, folder: str) -> DataFrame:
    """Documents against themselves normalised and their whole index."""
    documents = table(spark, folder, "documents")
    raw = register.raw_view(documents, "doc_id", _DOCUMENT_COLUMNS, "documents", "doc_id")
    normalised = documents.select(F.col("doc_id").cast("string").alias("record_id"))
    named = documents.withColumn("record_id", F.col("doc_id").cast("string"))
    indexed = indexed_ids(write_index(named, "record_id", ["text"], scratch_path(spark, "gram-index")), "record_id")
    return check_build(raw, normalised, indexed, "record_id", len(_DOCUMENT_COLUMNS))


@query("validate_build_orders", """
WITH o AS (SELECT count(*) AS n FROM orders), u AS (
  SELECT count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))
SELECT 'ERROR' AS severity, 'fts' AS category,
  'Index holds ' || (o.n - u.n) || ' records, register holds ' || o.n || '.' AS message FROM o, u
UNION ALL SELECT 'INFO', 'structure', 'Total records verified: ' || o.n || ', total columns: 6' FROM o
""")
def validate_build_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders against an index that lacks those without lines."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("record_id"))
    indexed = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("record_id")).distinct()
    return check_build(orders, orders, indexed, "record_id", len(_ORDER_COLUMNS))


@query("validate_build_problems", f"""
WITH k AS (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey // 2 END AS id, o_orderpriority FROM orders),
n AS (SELECT (SELECT count(*) FROM orders) AS total, (SELECT count(DISTINCT id) FROM k) AS ids)
SELECT 'ERROR' AS severity, 'fts' AS category, 'Index holds ' || ids || ' records, register holds ' || total || '.' AS message FROM n
UNION ALL SELECT 'ERROR', 'record_id', (SELECT count(*) FROM (SELECT id FROM k WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)) || ' ids occur more than once.'
UNION ALL SELECT 'ERROR', 'record_id', count(*) || ' records have no id.' FROM k WHERE id IS NULL
UNION ALL SELECT 'WARNING', 'normalization', count(*) || ' records hold unmapped values in o_orderpriority.' FROM k WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
UNION ALL SELECT 'INFO', 'structure', 'Total records verified: ' || total || ', total columns: 6' FROM n
""")
def validate_build_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with ids missing and repeated, and priorities half of which no accepted mapping knows."""
    key = F.when(F.col("o_orderkey") % 7 != 0, F.floor(F.col("o_orderkey") / 2))
    orders = table(spark, folder, "orders").select(key.alias("record_id"), "o_orderpriority")
    mapped = nz.apply_mappings(orders, ["o_orderpriority"], nz.dictionary_mappings(spark, "o_orderpriority", PRIORITIES[:2]), "record_id")
    indexed = orders.filter("record_id IS NOT NULL").select("record_id").distinct()
    return check_build(orders, mapped, indexed, "record_id", len(_ORDER_COLUMNS), ["o_orderpriority"])


@query("raw_preserved", f"""
SELECT 'text' AS column_id, count(*) AS n_records, count(*) FILTER (doc_id % 5 <> 0) AS n_preserved,
  count(*) FILTER (doc_id % 5 <> 0 AND text = {_CLEAN_SQL.format(c='text')}) AS n_verbatim FROM documents
UNION ALL SELECT 'source', count(*), count(*), count(*) FROM documents
""")
def raw_preserved(spark: SparkSession, folder: str) -> DataFrame:
    """A stored normalised table in which every fifth text was changed afterwards."""
    documents = table(spark, folder, "documents")
    raw = register.raw_view(documents, "doc_id", ["text", "source"], "documents", "doc_id")
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat(F.coalesce(clean(F.col("text")), F.lit("")), F.lit("!"))).otherwise(clean(F.col("text")))
    normalised = sinks.write_table(documents.select(
        F.col("doc_id").cast("string").alias("record_id"), changed.alias("text"), clean(F.col("source")).alias("source")
    ), scratch_path(spark, "normalised"))
    return nz.raw_preserved(raw, normalised, "record_id", ["text", "source"])


def _urgent(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 250000.0)).select("o_orderkey")


@query("export_filtered", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
  CAST(o_totalprice AS VARCHAR) AS o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders
WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 250000.0
""")
def export_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """The filtered export, written as CSV and read back."""
    path = scratch_path(spark, "filtered-records")
    sinks.export_filtered(table(spark, folder, "orders"), _urgent(spark, folder), path, "o_orderkey")
    fields = ", ".join(f"{c} string" for c in _ORDER_COLUMNS)
    stored = spark.read.schema(fields).options(**register.CSV_OPTIONS).option("header", True).csv(path)
    return stored.withColumn("o_orderdate", F.to_timestamp("o_orderdate").cast("string"))


@query("export_evidence_raw", """
SELECT CAST(doc_id AS VARCHAR) AS record_id, 'documents' AS source_file, CAST(doc_id AS VARCHAR) AS row_idx,
  text AS text_raw, lang AS lang_raw, source AS source_raw FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def export_evidence_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Whole raw texts of the toxic documents, written as CSV and read back."""
    documents = table(spark, folder, "documents")
    raw = register.raw_view(documents, "doc_id", ["text", "lang", "source"], "documents", "doc_id")
    cited = table(spark, folder, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("record_id"))
    path = scratch_path(spark, "evidence-raw")
    sinks.export_evidence_raw(raw, cited, path)
    fields = ", ".join(f"{c} string" for c in raw.columns)
    return spark.read.schema(fields).options(**register.CSV_OPTIONS).option("header", True).csv(path)


@query("export_judgments", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN toxic = 1 THEN 'MATCH' WHEN quality = 1 THEN 'NO_MATCH' ELSE 'UNCERTAIN' END AS judgment,
  'quality ' || quality AS reason FROM labels
""")
def export_judgments(spark: SparkSession, folder: str) -> DataFrame:
    """A judgment per label, written as CSV and read back."""
    judged = table(spark, folder, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "MATCH").when(F.col("quality") == 1, "NO_MATCH").otherwise("UNCERTAIN").alias("judgment"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("reason"), "toxic")
    path = scratch_path(spark, "judgments")
    sinks.export_judgments(judged, path, "doc_id")
    return spark.read.schema("doc_id string, judgment string, reason string").options(**register.CSV_OPTIONS).option("header", True).csv(path)


@query("export_build", f"""
SELECT 'normalize-map' AS published, raw_value AS a, canonical_id AS b, status AS c FROM ({_CANDIDATE_SQL})
UNION ALL SELECT 'normalized-data', CAST(event_id AS VARCHAR), coalesce(id, event_type), coalesce(label, event_type)
FROM events LEFT JOIN {_EVENT_SQL} ON lower(event_type) = alias
UNION ALL SELECT 'column-catalog', 'event_type', 'category', 'false'
UNION ALL SELECT 'validation-results', 'INFO', 'structure', 'Total records verified: ' || count(*) || ', total columns: 2' FROM events
""")
def export_build(spark: SparkSession, folder: str) -> DataFrame:
    """The four published tables of a build over the events, read back."""
    events = table(spark, folder, "events").select("event_id", "event_type")
    mappings = sinks.write_table(_event_mappings(spark, folder), scratch_path(spark, "event-map"))
    normalised = nz.apply_mappings(events, ["event_type"], mappings, "event_id")
    roles = profiling.infer_roles(profiling.profile_columns(events, ["event_type"]))
    ids = events.select("event_id")
    checks = check_build(ids, ids, ids, "event_id", 2).filter("category = 'structure'")
    path = scratch_path(spark, "published")
    sinks.export_build(normalised, profiling.catalog(roles), mappings, checks, path)

    def back(name: str, *columns: str) -> DataFrame:
        stored = spark.read.options(**register.CSV_OPTIONS).option("header", True).csv(f"{path}/{name}")
        return stored.select(F.lit(name).alias("published"), *[F.col(c).alias(n) for c, n in zip(columns, "abc")])

    return (
        back("normalize-map", "raw_value", "canonical_id", "status")
        .unionByName(back("normalized-data", "event_id", "event_type", "event_type_label"))
        .unionByName(back("column-catalog", "column_id", "role", "searchable"))
        .unionByName(back("validation-results", "severity", "category", "message"))
    )


@query("fingerprint_difference", """
WITH d AS (SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 4096 AS block FROM documents WHERE doc_id % 5 = 0)
SELECT doc_id, 'altered' AS change, (SELECT count(DISTINCT block) FROM d) AS n_blocks_read, 4096::BIGINT AS n_blocks FROM d
""")
def fingerprint_difference(spark: SparkSession, folder: str) -> DataFrame:
    """The rows altered as in ``raw_preserved``, found by comparing digests of two stored builds."""
    documents = table(spark, folder, "documents")
    altered = F.when(F.col("doc_id") % 5 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))
    first = digests.write_digested(documents, "doc_id", ["text", "source"], scratch_path(spark, "build"), levels=3)
    second = digests.write_digested(
        documents.withColumn("text", altered), "doc_id", ["text", "source"], scratch_path(spark, "build"), as_in=first)
    return digests.difference(first, second, "doc_id")
