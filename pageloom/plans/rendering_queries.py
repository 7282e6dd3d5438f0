"""Queries that render publications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators import publication_pages, rendering
from pageloom.plans.inputs import table


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as headings, lists, tables, footnotes and paragraphs."""
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("heading", "list", "table", "footnote", "paragraph")]), (k % 5 + 1).cast("int"))
    text = F.concat(F.lit("<Part> & "), k.cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        ((n * 1000000 + k) * 1000 + F.col("l_suppkey")).alias("ord"),
        kind.alias("type"),
        (n + 1).cast("int").alias("level"),
        F.concat(F.lit("s-"), k.cast("string")).alias("slug"),
        text.alias("text"),
        F.array(text, F.lit("b")).alias("items"),
        F.array(F.lit("A"), F.when(k % 2 == 0, "B").otherwise("")).alias("headers"),
        F.array(F.array(text, F.lit("'x'"))).alias("rows"),
    )


def html_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.bodies(_blocks(spark, sf_dir))


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("lang"), F.concat(F.lit("<p>"), "p_brand", F.lit("</p>")).alias("body"), F.concat(F.lit('{"a":"</'), "p_name", F.lit('"}')).alias("json_ld"))
    return rendering.pages(parts)


#: Line items, by their place in the order.
PLACED_SQL = "SELECT l_orderkey AS doc_id, 's' AS section_id, l_partkey AS k, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS ord FROM {lineitem}"


def nested_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sections: a reading list of two levels, and paragraphs of which those from the third on stand in a box, which the second is."""
    rows = spark.sql(PLACED_SQL, lineitem=table(spark, sf_dir, "lineitem"))
    headings = spark.sql("SELECT doc_id, section_id, ord, 2 + (ord + 1) % 2 AS level, 'h' || ord AS slug, 'T & ' || k AS text FROM {rows}", rows=rows)
    blocks = spark.sql("""
SELECT doc_id, section_id, 'b' || ord AS block_id, CASE WHEN ord > 2 THEN 'b2' END AS parent_id, ord, CASE ord WHEN 2 THEN 'box_section' ELSE 'paragraph' END AS type, CAST(NULL AS INT) AS level, 'x' || ord AS slug, 'Part <' || (k + 1000) || '> 1' AS text,
       CAST(NULL AS ARRAY<STRUCT<text: STRING, level: INT, ordered: BOOLEAN, value: INT>>) AS list_items, CAST(NULL AS STRING) AS style, CAST(NULL AS INT) AS start, CAST(NULL AS ARRAY<ARRAY<STRUCT<text: STRING, column_header: BOOLEAN, row_header: BOOLEAN, row_span: INT, col_span: INT>>>) AS cells, CAST(NULL AS STRING) AS caption, 'Box ' || k AS title, CASE WHEN k % 2 = 0 THEN 'Case-Study 1' END AS variant FROM {rows}""", rows=rows)  # fmt: skip
    notes = spark.sql("SELECT doc_id, section_id, 1 AS number, 'n1' AS note_id, 'A note' AS text FROM {rows} WHERE ord = 1 AND doc_id % 3 = 0", rows=rows)
    return publication_pages.section_bodies(blocks, notes).join(publication_pages.reading_lists(headings), ["doc_id", "section_id"]).select("doc_id", "links", "body")


QUERIES = {"html_bodies": html_bodies, "html_pages": html_pages, "nested_sections": nested_sections}
_T = "'&lt;Part&gt; &amp; ' || l_partkey"
ORACLES = {
    "html_bodies": f"""
SELECT l_orderkey AS doc_id, string_agg(CASE l_partkey % 5
  WHEN 0 THEN '<h' || least(6, greatest(2, l_linenumber + 1)) || ' id="s-' || l_partkey || '">' || {_T} || '</h' || least(6, greatest(2, l_linenumber + 1)) || '>'
  WHEN 1 THEN '<ul><li>' || {_T} || '</li><li>b</li></ul>'
  WHEN 2 THEN '<table><thead><tr><th scope="col">A</th><th scope="col">' || CASE WHEN l_partkey % 2 = 0 THEN 'B' ELSE '' END || '</th></tr></thead><tbody><tr><td>' || {_T} || '</td><td>&#x27;x&#x27;</td></tr></tbody></table>'
  WHEN 3 THEN '<p class="footnote" id="s-' || l_partkey || '">' || {_T} || '</p>'
  ELSE '<p>' || {_T} || '</p>' END, chr(10) ORDER BY (l_linenumber * 1000000 + l_partkey) * 1000 + l_suppkey) AS body
FROM lineitem GROUP BY 1""",
    "nested_sections": f"""
WITH r AS ({PLACED_SQL.replace("{lineitem}", "lineitem")}),
a AS (SELECT doc_id, ord, '<a href="#h' || ord || '">T &amp; ' || k || '</a>' AS a, '<p>Part &lt;' || (k + 1000) || '&gt;' || CASE WHEN doc_id % 3 = 0 THEN '<sup class="footnote-reference"><a href="#n1" role="doc-noteref" aria-label="Footnote 1">1</a></sup>' ELSE ' 1' END || '</p>' AS p, k FROM r),
l AS (SELECT x.doc_id, '<ul>' || string_agg('<li>' || x.a || coalesce('<ul><li>' || y.a || '</li></ul>', '') || '</li>', '' ORDER BY x.ord) || '</ul>' AS links FROM a x LEFT JOIN a y ON y.doc_id = x.doc_id AND y.ord = x.ord + 1 WHERE x.ord % 2 = 1 GROUP BY 1),
b AS (SELECT doc_id, max(p) FILTER (ord = 1) AS one, max(k) FILTER (ord = 2) AS k, coalesce(string_agg(p, '' ORDER BY ord) FILTER (ord > 2), '') AS held FROM a GROUP BY 1)
SELECT l.doc_id, links, one || CASE WHEN k IS NULL THEN '' ELSE '<section class="box box--' || CASE WHEN k % 2 = 0 THEN 'case-study' ELSE 'information' END || '" aria-labelledby="x2-title"><h3 id="x2-title">Box ' || k || '</h3>' || held || '</section>' END AS body FROM l JOIN b ON b.doc_id = l.doc_id""",
    "html_pages": """SELECT p_partkey AS doc_id, '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>' || p_name || '</title><script type="application/ld+json">{"a":"\\u003c/' || p_name || '"}</script></head><body><main><h1>' || p_name || '</h1><p>' || p_brand || '</p></main></body></html>' AS html FROM part""",
}
