"""Queries over the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators import review
from pageloom.plans.inputs import BLOCKS_SQL, RECORDS_SQL, blocks, duck, records

BLOCKS = duck(BLOCKS_SQL)
QUEUE = f"""
SELECT doc_id, 'review-' || row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS item_id, block_id, label AS type, page,
       round_even(sure, 4) AS confidence, CASE WHEN sure >= 0.55 THEN 'med' ELSE 'low' END AS band,
       CASE WHEN label IN ('table', 'document_index') THEN 'table' ELSE 'text' END AS kind, 'pending' AS status,
       CASE WHEN label NOT IN ('table', 'document_index') THEN text END AS extracted_text, ord AS original_index
FROM (SELECT *, coalesce(confidence, 0.5) AS sure FROM ({BLOCKS}))
WHERE label NOT IN ('header', 'footer') AND sure < 0.75 AND NOT (trim(text) = '' AND NOT has_table AND NOT has_bounds)"""
CATEGORY = "CASE WHEN starts_with({0}, 'section_header_') THEN 'headings' WHEN {0} = 'picture' THEN 'images' WHEN {0} = 'table' THEN 'tables' END"


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_queue(blocks(spark, sf_dir)).drop("evidence")


def review_filter_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending items whose shown text has `part 1`, most confident first."""
    items = review.filter_items(review_queue(spark, sf_dir), status="pending", text="Part 1")
    return items.orderBy(*review.sort_key("confidence_desc")).select("doc_id", "item_id", "type", "confidence")


def _patches(items: DataFrame) -> DataFrame:
    k = F.col("original_index") % 6
    changed = items.where(k < 4)
    return changed.select(
        "doc_id",
        "item_id",
        F.when(k == 0, "removed").when(k == 1, "accepted").alias("status"),
        F.when(k == 2, "text").alias("type"),
        F.when(k == 3, F.lit("corrected")).alias("corrected_text"),
    )


def review_bulk_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = review_queue(spark, sf_dir)
    return review.apply_patches(items, _patches(items)).select("doc_id", "item_id", "type", "status", "corrected_text", "removed")


def review_unknown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = review_queue(spark, sf_dir)
    asked = blocks(spark, sf_dir).select("doc_id", F.concat(F.lit("review-"), F.col("page").cast("string")).alias("item_id"))
    return review.unknown_ids(items, asked)


def review_resolve_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = review_queue(spark, sf_dir)
    return review.resolve_all(review.apply_patches(items, _patches(items))).groupBy("status").agg(F.count("*").alias("items"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.coverage(blocks(spark, sf_dir), review_queue(spark, sf_dir))


def document_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.document_confidence(blocks(spark, sf_dir).withColumn("confidence", F.col("confidence") * 0.777777))


def confidence_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).where("confidence is not null")
    return rows.groupBy("label", review.confidence_band(F.col("confidence")).alias("band")).agg(F.count("*").alias("blocks"))


QUERIES = {f.__name__: f for f in (review_queue, review_filter_sort, review_bulk_patch, review_unknown_ids, review_resolve_all, coverage, document_confidence, confidence_band)}
_PATCHED = f"""
SELECT doc_id, item_id, CASE WHEN k = 2 THEN 'text' ELSE type END AS type,
       CASE k WHEN 0 THEN 'removed' WHEN 1 THEN 'accepted' WHEN 2 THEN 'edited' WHEN 3 THEN 'edited' ELSE status END AS status,
       CASE WHEN k = 3 THEN 'corrected' END AS corrected_text, k = 0 AS removed
FROM (SELECT *, original_index % 6 AS k FROM ({QUEUE}))"""
ORACLES = {
    "review_queue": QUEUE,
    "review_filter_sort": f"SELECT doc_id, item_id, type, confidence FROM ({QUEUE}) WHERE status = 'pending' AND contains(lower(type || ' ' || coalesce(extracted_text, '')), 'part 1') ORDER BY doc_id, confidence DESC, original_index",
    "review_bulk_patch": _PATCHED,
    "review_unknown_ids": f"SELECT DISTINCT doc_id, 'review-' || page AS item_id FROM ({BLOCKS}) b WHERE NOT EXISTS (SELECT 1 FROM ({QUEUE}) q WHERE q.doc_id = b.doc_id AND q.item_id = 'review-' || b.page)",
    "review_resolve_all": f"SELECT CASE WHEN status IN ('pending', 'needs_attention') THEN 'accepted' ELSE status END AS status, count(*) AS items FROM ({_PATCHED}) GROUP BY 1",
    "coverage": f"""
WITH t AS (SELECT doc_id, {CATEGORY.format('label')} AS category, count(DISTINCT block_id) AS total FROM ({BLOCKS}) GROUP BY 1, 2),
w AS (SELECT doc_id, {CATEGORY.format('type')} AS category, count(DISTINCT block_id) AS waiting FROM ({QUEUE}) GROUP BY 1, 2)
SELECT t.doc_id, t.category, total, total - least(total, coalesce(waiting, 0)) AS detected, least(total, coalesce(waiting, 0)) AS needs_review
FROM t LEFT JOIN w ON w.doc_id = t.doc_id AND w.category = t.category WHERE t.category IS NOT NULL""",
    "document_confidence": f"SELECT doc_id, round_even(avg(confidence * 0.777777::DOUBLE), 4) AS confidence, count(confidence) AS scored_blocks FROM ({BLOCKS}) GROUP BY doc_id",
    "confidence_band": f"SELECT label, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.55 THEN 'med' ELSE 'low' END AS band, count(*) AS blocks FROM ({BLOCKS}) WHERE confidence IS NOT NULL GROUP BY 1, 2",
}


def coverage_with_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage with the blocks inside boxes, and a row of pages."""
    k = F.col("ord")
    child = F.struct(F.concat(F.lit("c-"), "block_id").alias("block_id"), F.when(k % 2 == 0, "picture").otherwise("table").alias("label"))
    rows = blocks(spark, sf_dir).withColumn("children", F.when(k % 5 == 0, F.array(child)))
    pages = rows.groupBy("doc_id").agg(F.max("page").alias("pages"))
    return review.coverage(rows, review_queue(spark, sf_dir), pages)


def scored_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's score for a third of the documents, that of their blocks for the others."""
    rows = blocks(spark, sf_dir).withColumn("confidence", F.col("confidence") * 0.777777)
    model = rows.groupBy("doc_id").agg((F.max("page") / 9).alias("mean_score")).where("doc_id % 3 = 0")
    return review.document_confidence(rows, model)


def review_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A piece of text in any field of an item, cells of tables and key-value pairs among them."""
    k = F.col("original_index")
    items = review_queue(spark, sf_dir).withColumns({
        "note": F.when(k % 7 == 0, F.concat(F.lit("Note "), (k % 90).cast("string"))),
        "key_values": F.when(k % 5 == 0, F.array(F.lit("Key"), (k % 1000).cast("string"))),
        "table_data": F.when(F.col("kind") == "table", F.struct(F.array(F.lit("H1"), F.lit("H2")).alias("headers"), F.array(F.array(F.lit("a"), (k % 1000).cast("string"))).alias("rows"))),
    })
    return review.filter_items(items, text="17", columns=("extracted_text", "note", "key_values", "table_data")).select("doc_id", "item_id")


def review_retyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each label turned into each type in turn, some with a corrected text: what they hold then."""
    k = F.col("ord")
    types = ("table", "list", "form", "footnote", "text", "section_header_2", "box_section")
    target = F.element_at(F.array(*[F.lit(t) for t in types]), (k % len(types) + 1).cast("int"))
    own = F.struct(F.array(F.lit("Name"), F.lit("Column 2")).alias("headers"), F.array(F.array(F.col("text"), F.col("page").cast("string")), F.array(F.lit(" "), F.lit("|"))).alias("rows"))
    rows = blocks(spark, sf_dir).withColumns({"target": target, "corrected": F.when(k % 3 == 0, F.concat(F.lit("1. "), "text", F.lit("\n- second | cell"))), "table": F.when(F.col("has_table"), own)})
    held = review.patched_content(F.col("target"), F.col("label"), F.col("corrected"), F.lit(None).cast(rows.schema["table"].dataType), F.col("text"), F.col("table"), F.lit(None).cast("array<struct<text:string,marker:string,enumerated:boolean,level:int>>"))
    return rows.withColumn("h", held).select("doc_id", "block_id", "target", "h.kind", "h.text", F.size("h.entries").alias("entries"), F.array_join("h.table.headers", "|").alias("headers"), "h.boxed")


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approval of every record, with the reason where it is refused: a third of them has an open item."""
    rows = records(spark, sf_dir)
    items = rows.select(F.col("id").alias("doc_id"), F.when(F.col("record_key") % 3 == 1, "pending").otherwise("accepted").alias("status"))
    metadata = rows.select(F.col("id").alias("doc_id"), "title", "publisher")
    return review.approved(rows, items, metadata, F.lit("2025-01-01")).select("id", "approved_at", "reason")


def withdrawn_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return review.withdrawn(rows, rows.where("record_key % 16 = 0").select(F.col("id").alias("doc_id"))).select("id", "approved_at")


def metadata_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    metadata = rows.where("record_key % 2 = 0").select(F.col("id").alias("doc_id"), F.when(F.col("record_key") % 4 == 0, "").otherwise("New title").alias("title"), F.lit("Press").alias("publisher"))
    return review.metadata_saved(rows, metadata).select("id", "title", "publisher", "metadata_confirmed", "approved_at")


def next_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a selection goes when all but every third item leave the list."""
    before = review_queue(spark, sf_dir).select("doc_id", "item_id", F.col("original_index").alias("position"))
    first = before.groupBy("doc_id").agg(F.max_by("item_id", F.col("position") % 1009 * 10**12 + F.col("position")).alias("item_id"))
    return review.next_selected(before, before.where("position % 3 = 0"), first)


def selected_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = review_queue(spark, sf_dir).select("doc_id", "item_id", F.col("original_index").alias("position"))
    ends = items.groupBy("doc_id").agg(F.max_by("item_id", F.col("position") % 1009 * 10**12 + F.col("position")).alias("first_id"), F.min_by("item_id", F.col("position") % 1009 * 10**12 + F.col("position")).alias("second_id"))
    return review.between(items, ends)


QUERIES |= {f.__name__: f for f in (coverage_with_boxes, scored_confidence, review_search, review_retyped, approvals, withdrawn_approvals, metadata_saves, next_selected, selected_range)}
_RECORDS = duck(RECORDS_SQL)
_CELLS = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
ORACLES |= {
    "coverage_with_boxes": f"""
WITH e AS (SELECT doc_id, block_id, label FROM ({BLOCKS}) UNION ALL SELECT doc_id, 'c-' || block_id, CASE WHEN ord % 2 = 0 THEN 'picture' ELSE 'table' END FROM ({BLOCKS}) WHERE ord % 5 = 0),
t AS (SELECT doc_id, {CATEGORY.format('label')} AS category, count(DISTINCT block_id) AS total FROM e GROUP BY 1, 2),
w AS (SELECT doc_id, {CATEGORY.format('type')} AS category, count(DISTINCT block_id) AS waiting FROM ({QUEUE}) GROUP BY 1, 2)
SELECT t.doc_id, t.category, total, total - least(total, coalesce(waiting, 0)) AS detected, least(total, coalesce(waiting, 0)) AS needs_review
FROM t LEFT JOIN w ON w.doc_id = t.doc_id AND w.category = t.category WHERE t.category IS NOT NULL
UNION ALL SELECT doc_id, 'pages', max(page)::BIGINT, max(page)::BIGINT, 0 FROM ({BLOCKS}) GROUP BY 1""",
    "scored_confidence": f"""
SELECT doc_id, round_even(s, 4) AS confidence, CASE WHEN s >= 0.75 THEN 'high' WHEN s >= 0.55 THEN 'med' WHEN s IS NOT NULL THEN 'low' END AS band, CASE WHEN m IS NOT NULL THEN 'document' WHEN s IS NOT NULL THEN 'blocks' END AS source
FROM (SELECT *, coalesce(m, b) AS s FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN max(page) / 9 END AS m, avg(confidence * 0.777777::DOUBLE) AS b FROM ({BLOCKS}) GROUP BY 1))""",
    "review_search": f"""
SELECT doc_id, item_id FROM ({QUEUE}) WHERE contains(coalesce(extracted_text, ''), '17') OR original_index % 7 = 0 AND contains('note ' || original_index % 90, '17')
  OR (original_index % 5 = 0 OR kind = 'table') AND contains((original_index % 1000)::VARCHAR, '17')""",
    "review_retyped": f"""
WITH b AS (SELECT *, ['table', 'list', 'form', 'footnote', 'text', 'section_header_2', 'box_section'][ord % 7 + 1] AS target, ord % 3 = 0 AS fixed, {_CELLS} AS cell, '1. ' || text || chr(10) || '- second | cell' AS corrected FROM ({BLOCKS})),
f AS (SELECT *, array_to_string(list_filter([cell, page::VARCHAR], lambda x: x <> ''), ' — ') AS dashed,
             CASE WHEN cell = '' THEN '' ELSE 'Name: ' || cell || '~' END || page AS facts FROM b)
SELECT doc_id, block_id, target, CASE WHEN target = 'table' THEN 'table' ELSE 'text' END AS kind,
  CASE target
    WHEN 'table' THEN CASE WHEN has_table THEN 'Name | Column 2' || chr(10) || trim(text) || ' | ' || page
                           WHEN fixed THEN trim('1. ' || text) || ' | ' || chr(10) || '- second | cell' ELSE 'Column 1' || CASE WHEN trim(text) = '' THEN '' ELSE chr(10) || trim(text) END END
    WHEN 'list' THEN CASE WHEN fixed THEN CASE WHEN cell = '' THEN '1.' ELSE '1. ' || cell END || chr(10) || '- second cell' WHEN has_table THEN dashed ELSE cell END
    WHEN 'form' THEN CASE WHEN fixed THEN corrected WHEN has_table THEN replace(facts, '~', chr(10)) ELSE text END
    WHEN 'footnote' THEN CASE WHEN fixed THEN corrected WHEN has_table THEN replace(facts, '~', '; ') || '.' ELSE text END
    WHEN 'text' THEN CASE WHEN fixed THEN corrected WHEN has_table THEN dashed ELSE text END
    WHEN 'section_header_2' THEN CASE WHEN fixed THEN CASE WHEN cell = '' THEN '1.' ELSE cell END || ' second cell' WHEN has_table THEN dashed ELSE cell END
    ELSE trim(CASE WHEN fixed THEN corrected ELSE text END) END AS text,
  CASE WHEN target = 'list' THEN CASE WHEN fixed THEN 2 WHEN has_table OR cell <> '' THEN 1 ELSE 0 END END AS entries,
  CASE WHEN target = 'table' THEN CASE WHEN has_table THEN 'Name|Column 2' WHEN fixed THEN trim('1. ' || text) || '|' ELSE 'Column 1' END END AS headers,
  CASE WHEN target = 'box_section' THEN label END AS boxed FROM f""",
    "approvals": f"""
SELECT id, CASE WHEN reason IS NULL THEN '2025-01-01' END AS approved_at, reason FROM (
  SELECT id, CASE WHEN record_key % 3 = 1 THEN 'open_review_items' WHEN NOT metadata_confirmed THEN 'metadata_not_confirmed' WHEN trim(title) = '' OR trim(publisher) = '' THEN 'title_or_publisher_missing' END AS reason FROM ({_RECORDS}))""",
    "withdrawn_approvals": f"SELECT id, CASE WHEN record_key % 16 <> 0 THEN approved_at END AS approved_at FROM ({_RECORDS})",
    "metadata_saves": f"SELECT id, CASE WHEN record_key % 4 = 2 THEN 'New title' ELSE title END AS title, CASE WHEN record_key % 2 = 0 THEN 'Press' ELSE publisher END AS publisher, record_key % 2 = 0 OR metadata_confirmed AS metadata_confirmed, CASE WHEN record_key % 2 = 1 THEN approved_at END AS approved_at FROM ({_RECORDS})",
    "next_selected": f"""
WITH q AS (SELECT doc_id, item_id, original_index AS p FROM ({QUEUE})), s AS (SELECT doc_id, max_by(p, p % 1009 * 1000000000000 + p) AS chosen FROM q GROUP BY 1)
SELECT q.doc_id, coalesce(min_by(item_id, p) FILTER (p >= chosen), max_by(item_id, p) FILTER (p < chosen)) AS item_id FROM q JOIN s ON s.doc_id = q.doc_id WHERE p % 3 = 0 GROUP BY 1""",
    "selected_range": f"""
WITH q AS (SELECT doc_id, item_id, original_index AS p FROM ({QUEUE})), s AS (SELECT doc_id, max_by(p, p % 1009 * 1000000000000 + p) AS a, min_by(p, p % 1009 * 1000000000000 + p) AS b FROM q GROUP BY 1)
SELECT q.doc_id, item_id FROM q JOIN s ON s.doc_id = q.doc_id WHERE p BETWEEN least(a, b) AND greatest(a, b)""",
}
