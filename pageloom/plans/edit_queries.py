"""Queries of edits that change several tables at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators import edits
from pageloom.plans.inputs import table

#: Line items as blocks under review; every third order has patches, and every seventh names an item that doesn't exist.
ITEMS_SQL = "SELECT l_orderkey AS doc_id, l_partkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth FROM {lineitem}"
PATCHES_SQL = """
SELECT doc_id, 'i' || nth AS item_id, CASE nth WHEN 1 THEN 'removed' WHEN 3 THEN 'accepted' END AS status, CASE nth WHEN 2 THEN 'table' WHEN 4 THEN 'box_section' WHEN 5 THEN 'list' WHEN 6 THEN 'section_header_2' END AS type, CASE nth WHEN 5 THEN 'a | b' WHEN 3 THEN 'As it is' END AS corrected_text, 1 AS ord FROM {items} WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'i' || nth, NULL, CASE nth WHEN 1 THEN 'text' END, CASE nth WHEN 1 THEN 'Put right' ELSE '1. one' || chr(10) || '• two' END, 2 FROM {items} WHERE doc_id % 3 = 0 AND nth IN (1, 5)
UNION ALL SELECT doc_id, 'i0', 'accepted', NULL, NULL, 3 FROM {items} WHERE doc_id % 21 = 0 AND nth = 1"""


def review_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, blocks, approval and outputs after the patches of an order: one row an item."""
    made = spark.sql(ITEMS_SQL, lineitem=table(spark, sf_dir, "lineitem"))
    name = lambda letter: F.concat(F.lit(letter), F.col("nth").cast("string"))
    label = F.when(F.col("k") % 2 == 0, "text").otherwise("list")
    text = F.concat(F.lit("Part "), F.col("k").cast("string"), F.lit(" | of law\nand more"))
    items = made.select("doc_id", name("i").alias("item_id"), name("b").alias("block_id"), label.alias("type"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("corrected_text"), F.lit(None).cast(edits.TABLE).alias("corrected_table"))
    blocks = made.select("doc_id", name("b").alias("block_id"), label.alias("label"), text.alias("text"), F.lit(None).cast(edits.TABLE).alias("table_data"), F.lit(None).cast(edits.ENTRIES).alias("list_entries"), F.lit(None).cast("string").alias("box_title"), F.lit(None).cast("string").alias("box_kind"), F.lit(None).cast(edits.CHILDREN).alias("children"), F.lit(False).alias("removed"))
    docs = made.select("doc_id").distinct()
    records = docs.select(F.col("doc_id").alias("id"), F.lit("2024-05-01").alias("approved_at"))
    artifacts = docs.select(F.col("doc_id").alias("document_id"), F.explode(F.array(*map(F.lit, ("source.pdf", "publication.json", "accessible.html")))).alias("name"), F.lit("x").alias("value"))
    after = edits.edited(items, blocks, records, artifacts, spark.sql(PATCHES_SQL, items=made))
    outputs = after.artifacts.groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("outputs"))
    rows = after.items.join(after.blocks, ["doc_id", "block_id"]).join(after.records.select(F.col("id").alias("doc_id"), "approved_at"), "doc_id").join(outputs, "doc_id")
    return rows.select("doc_id", "item_id", "type", "status", "label", "text", "corrected_text", F.array_join(F.col("corrected_table.headers"), "~").alias("headers"), F.array_join(F.transform("list_entries", lambda e: F.concat(e["marker"], F.lit(":"), e["text"])), "~").alias("entries"), F.array_join(F.transform("children", lambda c: F.concat(c["label"], F.lit(":"), c["text"])), "~").alias("boxed"), "box_kind", "removed", "approved_at", "outputs")


_FRAME = lambda sql: sql.replace("{lineitem}", "lineitem").replace("{items}", "made")
QUERIES = {"review_edits": review_edits}
ORACLES = {
    "review_edits": f"""
WITH made AS ({_FRAME(ITEMS_SQL)}),
patches AS ({_FRAME(PATCHES_SQL)}),
held AS (SELECT p.*, coalesce(p.status, CASE WHEN p.type IS NOT NULL OR p.corrected_text IS NOT NULL THEN 'edited' END) AS set_status FROM patches p
         WHERE NOT EXISTS (SELECT 1 FROM patches q WHERE q.doc_id = p.doc_id AND NOT EXISTS (SELECT 1 FROM made WHERE made.doc_id = q.doc_id AND 'i' || made.nth = q.item_id))),
merged AS (SELECT doc_id, item_id, max_by(set_status, ord) FILTER (set_status IS NOT NULL) AS status, max_by(type, ord) FILTER (type IS NOT NULL) AS type, max_by(corrected_text, ord) FILTER (corrected_text IS NOT NULL) AS said FROM held GROUP BY 1, 2),
met AS (SELECT m.doc_id, 'i' || nth AS item_id, CASE WHEN k % 2 = 0 THEN 'text' ELSE 'list' END AS was, 'Part ' || k || ' | of law' AS line, p.item_id IS NOT NULL AS hit, p.status, coalesce(p.type, CASE WHEN k % 2 = 0 THEN 'text' ELSE 'list' END) AS target, said,
        EXISTS (SELECT 1 FROM held h WHERE h.doc_id = m.doc_id) AS touched FROM made m LEFT JOIN merged p ON p.doc_id = m.doc_id AND p.item_id = 'i' || m.nth),
split AS (SELECT *, string_split(coalesce(said, replace(line, ' |', CASE WHEN target = 'list' OR target LIKE 'section%' THEN ' ' ELSE ' |' END) || chr(10) || 'and more'), chr(10)) AS ls FROM met),
parsed AS (SELECT *, [CASE WHEN regexp_matches(x, '^([0-9]+[.]|•) ') THEN regexp_extract(x, '^([0-9]+[.]|•) ', 1) ELSE '' END || ':' || trim(regexp_replace(regexp_replace(regexp_replace(x, '^([0-9]+[.]|•) ', ''), '[|]', ' ', 'g'), ' +', ' ', 'g')) FOR x IN ls] AS es FROM split),
final AS (SELECT *, CASE WHEN NOT hit THEN line || chr(10) || 'and more' WHEN target IN ('table', 'box_section') THEN line || chr(10) || 'and more' || CASE WHEN target = 'table' THEN ' | ' ELSE '' END
          WHEN target = 'list' THEN array_to_string([trim(replace(e, ':', CASE WHEN e LIKE ':%' THEN '' ELSE ' ' END)) FOR e IN es], chr(10)) WHEN target LIKE 'section%' THEN array_to_string([regexp_replace(e, '^.*:', '') FOR e IN es], ' ') ELSE array_to_string(ls, chr(10)) END AS text FROM parsed)
SELECT doc_id, item_id, target AS type, CASE WHEN hit THEN coalesce(status, 'pending') ELSE 'pending' END AS status, target AS label, text, CASE WHEN hit AND target <> 'table' THEN text END AS corrected_text,
       CASE WHEN hit AND target = 'table' THEN replace(line, ' | ', '~') END AS headers, CASE WHEN hit AND target = 'list' THEN array_to_string(es, '~') END AS entries, CASE WHEN target = 'box_section' THEN was || ':' || line || chr(10) || 'and more' END AS boxed,
       CASE WHEN target = 'box_section' THEN 'information' END AS box_kind, hit AND coalesce(status = 'removed', FALSE) AS removed, CASE WHEN NOT touched THEN '2024-05-01' END AS approved_at, CASE WHEN touched THEN 1 ELSE 3 END AS outputs
FROM final"""
}
