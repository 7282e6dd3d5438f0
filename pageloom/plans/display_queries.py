"""Queries over what people see of documents, items and audit entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import display
from pageloom.operators import review
from pageloom.plans.inputs import AUDIT_SQL, audit_log, duck, table
from pageloom.plans.review_queries import QUEUE, review_queue
from pageloom.sources.records import size_label


def file_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers and segments as file names."""
    name = F.concat(F.lit("in/"), F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, "_ForWeb-").otherwise("-"), F.translate("c_name", "#", "_"), F.when(F.col("c_custkey") % 2 == 0, ".v2.pdf").otherwise("_FNL.pdf"))
    return table(spark, sf_dir, "customer").select("c_custkey", display.file_title(name).alias("title"))


def redacted_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    key = F.when(k % 4 == 0, "corrected_text").when(k % 4 == 1, "corrected_table").otherwise("status")
    return table(spark, sf_dir, "orders").select("o_orderkey", display.redacted(F.create_map(key, F.col("o_orderpriority"), F.lit("label"), F.col("o_orderstatus"))).alias("m")).select(
        "o_orderkey", F.to_json("m").alias("changes")
    )


def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, page = F.col("p_name"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", display.item_label(title, page).alias("label"), size_label(F.col("p_partkey") * 131072).alias("size"))


def failure_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events as statuses of answers, with and without an explanation."""
    status = F.element_at(F.array(*[F.lit(s) for s in (0, 400, 401, 404, 408, 413, 415, 422, 500, 503)]), (F.col("event_id") % 10 + 1).cast("int"))
    detail = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("about "), F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", display.failure_message(status, detail).alias("message"))


def evidence_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    bounds = F.when(k % 3 > 0, F.struct((k % 90).alias("left"), (k % 70).alias("top"), (k % 90 + 9).alias("right"), F.when(k % 2 == 0, k % 70 + 5).alias("bottom")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", display.evidence_version(F.when(k % 4 > 0, F.concat(F.lit("b"), k.cast("string"))), F.concat(F.lit("review-"), F.col("l_linenumber").cast("string")), F.col("l_linenumber"), bounds).alias("version"))


def array_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are ordered together, as a list of an audit entry."""
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 3000).alias("list")).agg(F.array_sort(F.collect_set(F.col("l_partkey"))).alias("p")).select("list", display.array_preview(F.transform("p", lambda x: x.cast("string"))).alias("preview"))


def table_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of each part with a header and a cell set, a column put in and one taken out, a row put in and one taken out."""
    k = F.col("p_partkey")
    headers, rows = F.array("p_brand", "p_type"), F.array(F.array("p_name"), F.array("p_type", "p_brand"), F.array(F.lit("x"), F.lit("y"), F.lit("z")))
    h1 = display.with_header(headers, k % 2, F.lit("New"))
    r1 = display.with_cell(h1, rows, (k % 3), (k % 2), F.lit("set"))
    h2, r2 = display.with_column(h1, r1)
    h3, r3 = display.without_column(h2, r2, k % 4)
    r4 = display.without_row(display.with_row(h3, r3), k % 5)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(h3, "|").alias("headers"), F.array_join(F.transform(r4, lambda r: F.array_join(r, "|")), "/").alias("rows"))


def item_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = review_queue(spark, sf_dir).withColumn("status", F.element_at(F.array(*[F.lit(s) for s in ("pending", "needs_attention", "accepted", "edited", "removed")]), (F.col("original_index") % 5 + 1).cast("int")))
    return items.select("doc_id", "item_id", display.item_tone(F.col("status"), F.col("band")).alias("tone"), display.confidence_label(F.col("band"), F.col("confidence")).alias("label"))


def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and settled items of each document, what has to be looked at by hand, and whether it is ready for approval."""
    items = review_queue(spark, sf_dir).withColumn("status", F.when(F.col("original_index") % 3 == 0, "pending").otherwise("accepted"))
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(" ").alias("citations"), (F.col("o_orderkey") % 5 > 0).alias("metadata_confirmed"))
    return review.progress(documents, items).select("doc_id", "pending", "resolved", "ready", F.array_join("checks", ",").alias("checks"))


def fields_to_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    fields = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.col("o_orderpriority").alias("field"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "med").otherwise("low").alias("band"), (k % 7 == 0).alias("approved"), F.when(k % 11 == 0, F.lit("")).otherwise(F.col("o_orderstatus")).alias("value"))
    return review.fields_to_review(fields, required=("1-URGENT", "2-HIGH"))


def own_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of edits whose label has a piece of text."""
    return review.own_history(audit_log(spark, sf_dir), "7", text="EDITED").select("id", "action", "label")


def short_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir).select("o_orderkey", display.short_date(F.col("value")).alias("shown"))


def long_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir).select("o_orderkey", display.long_date(F.col("value")).alias("shown"))


def audit_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 50 == 0, "unknown").otherwise(F.date_format(F.to_timestamp(F.col("ts").cast("string")), "yyyy-MM-dd HH:mm:ss"))
    shown = display.audit_time(value)
    return table(spark, sf_dir, "events").select("event_id", shown["date"].alias("shown_date"), shown["time"].alias("shown_time"))


FORMS = 9


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates, and days that don't exist, in the forms that people write."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("string").cast("timestamp_ntz")
    form = lambda f: F.date_format(at, f)
    written = [form("yyyy-MM-dd"), F.concat(form("yyyy-MM-dd"), F.lit("T00:00:00.000Z")), form("d MMMM yyyy"), form("dd/MM/yyyy"), F.concat(F.lit("Published on "), form("MMMM"), F.lit(" "), form("d"), F.lit("th, "), form("yyyy"), F.lit(".")), F.lit("Spring 2026."), F.lit("31/02/2020"), form("d MMM yyyy"), F.lit("  ")]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*written), (k % FORMS + 1).cast("int")).alias("value"))


QUERIES = {f.__name__: f for f in (file_titles, redacted_changes, size_labels, failure_messages, evidence_versions, array_previews, table_edits, item_tones, review_progress, fields_to_review, own_history, short_dates, long_dates, audit_times)}

_STATUS = "[0, 400, 401, 404, 408, 413, 415, 422, 500, 503][event_id % 10 + 1]"
_TEXTS = " ".join("WHEN {} THEN '{}'".format(c, t.replace("'", "''")) for c, t in display.MESSAGES.items())
_WRITTEN = """CASE o_orderkey % 9 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') WHEN 2 THEN strftime(o_orderdate, '%-d %B %Y')
  WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 4 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 5 THEN 'Spring 2026' WHEN 6 THEN '31/02/2020' WHEN 7 THEN strftime(o_orderdate, '%-d %b %Y') ELSE 'date not specified' END"""
_WORDS = "strftime(o_orderdate, '%B %-d, %Y')"
ORACLES = {
    "file_titles": r"""
SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_mktsegment) || CASE WHEN c_custkey % 3 = 0 THEN ' ForWeb ' ELSE ' ' END || replace(replace(c_name, '#', ' '), '-', ' ') || CASE WHEN c_custkey % 2 = 0 THEN '.v2' ELSE ' FNL' END,
       '\b(forweb|web|fnl|parl)\b', '', 'gi'), '\s+', ' ', 'g')) AS title FROM customer""",
    "redacted_changes": """
SELECT o_orderkey, '{"' || CASE o_orderkey % 4 WHEN 0 THEN 'corrected_text' WHEN 1 THEN 'corrected_table' ELSE 'status' END || '":"' || CASE WHEN o_orderkey % 4 < 2 THEN 'updated' ELSE o_orderpriority END || '","label":"' || o_orderstatus || '"}' AS changes FROM orders""",
    "size_labels": "SELECT p_partkey, p_name || CASE WHEN p_partkey % 5 > 0 THEN ' (p.' || p_size || ')' ELSE '' END AS label, printf('%.1f MB', p_partkey / 8.0) AS size FROM part",
    "failure_messages": f"""
SELECT event_id, CASE WHEN user_id % 3 = 0 AND s NOT IN (0, 401, 408) THEN 'about ' || event_type ELSE CASE s {_TEXTS} ELSE CASE WHEN s >= 500 THEN '{display.SERVER_MESSAGE}' ELSE '{display.OTHER_MESSAGE}' END END END AS message
FROM (SELECT *, {_STATUS} AS s FROM events)""",
    "evidence_versions": """
SELECT l_orderkey, l_linenumber, concat_ws(':', CASE WHEN k % 4 > 0 THEN 'b' || k ELSE 'review-' || l_linenumber END, l_linenumber, CASE WHEN k % 3 > 0 THEN concat_ws(':', k % 90, k % 70, k % 90 + 9, CASE WHEN k % 2 = 0 THEN k % 70 + 5 END) END) AS version
FROM (SELECT *, l_partkey AS k FROM lineitem)""",
    "array_previews": "SELECT list, array_to_string(p[1:8], ', ') || CASE WHEN len(p) > 8 THEN ' and ' || (len(p) - 8) || ' more' ELSE '' END AS preview FROM (SELECT l_orderkey % 3000 AS list, list_sort(list(DISTINCT l_partkey)) AS p FROM lineitem GROUP BY 1)",
    "table_edits": """
WITH a AS (SELECT p_partkey, p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN ['New', p_type] ELSE [p_brand, 'New'] END AS h, [[p_name], [p_type, p_brand], ['x', 'y', 'z']] AS r FROM part),
b AS (SELECT k, list_append(h, 'Column 3') AS h, [list_append(CASE WHEN k % 3 = i THEN [CASE WHEN k % 2 = j THEN 'set' ELSE coalesce(r[i + 1][j + 1], '') END FOR j IN [0, 1]] ELSE r[i + 1] END, '') FOR i IN [0, 1, 2]] AS r FROM a),
c AS (SELECT k, [h[j + 1] FOR j IN range(len(h)) IF j <> k % 4] AS h, [[x[j + 1] FOR j IN range(len(x)) IF j <> k % 4] FOR x IN r] AS r FROM b),
d AS (SELECT k, h, list_append(r, ['' FOR x IN h]) AS r FROM c)
SELECT k AS p_partkey, array_to_string(h, '|') AS headers, array_to_string([array_to_string(r[i + 1], '|') FOR i IN range(len(r)) IF i <> k % 5], '/') AS rows FROM d""",
    "item_tones": f"""
SELECT doc_id, item_id, CASE WHEN original_index % 5 > 1 THEN 'ok' WHEN original_index % 5 = 1 OR band = 'low' THEN 'alert' ELSE 'warn' END AS tone,
       CASE band WHEN 'med' THEN 'Medium' ELSE 'Low' END || ' confidence, ' || floor(confidence * 100 + 0.5)::BIGINT || '%' AS label FROM ({QUEUE})""",
    "review_progress": f"""
WITH i AS (SELECT doc_id, count(*) FILTER (original_index % 3 = 0) AS pending, count(*) FILTER (original_index % 3 <> 0) AS resolved, bool_or(type IN ('table', 'document_index', 'box_section', 'picture')) AS visual FROM ({QUEUE}) GROUP BY 1)
SELECT o_orderkey AS doc_id, coalesce(pending, 0) AS pending, coalesce(resolved, 0) AS resolved, coalesce(pending, 0) = 0 AND o_orderkey % 5 > 0 AS ready,
       'content' || CASE WHEN visual THEN ',tables' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN ',citations' ELSE '' END AS checks
FROM orders LEFT JOIN i ON doc_id = o_orderkey""",
    "fields_to_review": "SELECT o_orderkey AS doc_id, o_orderpriority AS field, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'med' ELSE 'low' END AS band FROM orders WHERE o_orderkey % 11 = 0 AND o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0",
    "own_history": f"SELECT id, action, CASE action WHEN 'edit_review_item' THEN 'Edited review item' ELSE 'Edited metadata' END AS label FROM ({duck(AUDIT_SQL)}) WHERE actor_id = '7' AND action IN ('edit_review_item', 'edit_metadata')",
    "short_dates": f"SELECT o_orderkey, CASE WHEN o_orderkey % 9 < 2 THEN {_WORDS} ELSE {_WRITTEN} END AS shown FROM orders",
    "long_dates": f"SELECT o_orderkey, CASE WHEN o_orderkey % 9 IN (0, 1, 2, 3, 4, 7) THEN {_WORDS} ELSE {_WRITTEN} END AS shown FROM orders",
    "audit_times": "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'unknown' ELSE strftime(ts, '%d %b %Y') END AS shown_date, CASE WHEN event_id % 50 = 0 THEN '' ELSE lower(strftime(ts, '%I:%M:%S %p')) END AS shown_time FROM events",
}
