"""Queries over publications: summaries, display titles, boxes, tables, checks and the linked graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators import publication, rendering
from pageloom.plans.inputs import table
from pageloom.plans.layout_queries import HEADINGS, _headings

#: Line items as blocks: headings that summaries stand under, texts, lists and furniture.
SUMMARY_SQL = """
SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS ord, l_partkey AS k,
       ['section_header_1', 'section_header_2', 'section_header_3', 'text', 'text', 'text', 'list', 'footer'][l_partkey % 8 + 1] AS label,
       CASE WHEN l_partkey % 8 < 3 THEN ['Introduction', '1. Executive Summary', 'Chapter 2: Overview', 'Other matters', 'B. Scope of the Report'][l_suppkey % 5 + 1]
            WHEN l_partkey % 8 = 6 THEN '' ELSE repeat('Word' || (l_suppkey % 9) || ' ', (l_partkey % 30)) END AS text,
       CASE WHEN l_partkey % 8 = 6 THEN ['1.2 ' || repeat('item ', l_suppkey % 20), 'short', repeat('entry ', l_partkey % 12)] END AS items
FROM lineitem"""
WORDS = "['executive summary', 'summary', 'scope of report', 'scope of the report', 'scope of this report', 'overview', 'introduction']"


def _summary_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    of = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    kind = k % 8
    heading = of(("Introduction", "1. Executive Summary", "Chapter 2: Overview", "Other matters", "B. Scope of the Report"), s % 5)
    words = F.repeat(F.concat(F.lit("Word"), (s % 9).cast("string"), F.lit(" ")), (k % 30).cast("int"))
    items = F.array(F.concat(F.lit("1.2 "), F.repeat(F.lit("item "), (s % 20).cast("int"))), F.lit("short"), F.repeat(F.lit("entry "), (k % 12).cast("int")))
    label = of(("section_header_1", "section_header_2", "section_header_3", "text", "text", "text", "list", "footer"), kind)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 1000000 + k).alias("ord"), label.alias("label"), F.when(kind < 3, heading).when(kind == 6, "").otherwise(words).alias("text"), F.when(kind == 6, items).alias("items"))


def summary_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publication.summary_sources(_summary_blocks(spark, sf_dir)).select("doc_id", "source", F.coalesce(F.array_join("values", "|"), F.lit("")).alias("of"))


def publication_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed sentence of documents without a source; the others' summaries have a query of their own."""
    rows = _summary_blocks(spark, sf_dir)
    names = rows.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("name")).distinct()
    return publication.publication_summary(rows, names).where(F.col("summary").startswith("This publication presents"))


def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their display title, and how many blocks stay."""
    sectioned = publication.sections(_headings(spark, sf_dir))
    kept, shown = publication.own_titles(sectioned, publication.section_table(sectioned).select("doc_id", "section", "title"))
    return shown.join(kept.groupBy("doc_id", "section").agg(F.count("*").alias("blocks")), ["doc_id", "section"], "left").select("doc_id", "section", "title", "display_title", F.coalesce("blocks", F.lit(0)).alias("blocks"))


def reader_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publication.reader_sections(publication.section_table(publication.sections(_headings(spark, sf_dir)))).select("doc_id", "section", "title", "blocks")


def major_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _headings(spark, sf_dir).withColumn("seq", F.when(F.col("ord") % 3 > 0, F.col("ord") % 100))
    return publication.major_headings(rows).select("doc_id", "ord", F.col("place").cast("bigint").alias("place"))


def publication_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    made = F.struct(F.when(k % 3 > 0, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>")).alias("headers"), F.array(F.array("p_name", F.when(k % 2 == 0, F.col("p_size").cast("string"))), F.array("p_type")).alias("rows"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(publication.publication_cells(made)).alias("row", "cells"))
    return rows.select("p_partkey", "row", F.explode("cells").alias("c")).select("p_partkey", "row", "c.start_column", "c.text", "c.column_header")


LABELS = ("list", "table", "picture", "footnote", "section_header_7", "formula", "form", "text", "text")


def boxed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of parts: with a child of each kind in turn, and without children."""
    k = F.col("p_partkey")
    text = F.when(k % 9 == 2, F.lit(" ")).when(k % 9 == 7, F.concat(F.lit("1.2 "), "p_name")).when(k % 9 == 8, F.when(k % 2 == 0, F.lit("")).otherwise("plain")).otherwise(F.col("p_name"))
    child = F.struct(F.element_at(F.array(*[F.lit(x) for x in LABELS]), (k % 9 + 1).cast("int")).alias("label"), text.alias("text"), F.when(k % 4 > 0, F.col("p_size")).cast("int").alias("page"))
    own = F.when(k % 20 == 0, F.concat(F.lit("- "), "p_name", F.lit("\n- "), "p_brand")).otherwise(F.concat("p_name", F.lit("\n\n"), "p_brand", F.lit("\n")))
    content = publication.boxed_content(own, F.lit(7), F.when(k % 5 > 0, F.array(child)))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(content).alias("at", "c")).select("p_partkey", "at", "c.*")


def figures_captioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    child = F.struct(F.when(k % 3 == 0, "figure").otherwise("table").alias("type"), F.when(k % 11 > 0, "c").otherwise(" ").alias("caption"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(k % 4 == 0, "figure").otherwise("text").alias("type"), F.when(k % 8 == 0, "said").alias("caption"), F.when(k % 2 == 1, F.array(child)).alias("children"))
    return publication.figures_captioned(rows)


def publication_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("section"), (F.col("l_linenumber") * 1000000 + k).alias("ord"),
        F.element_at(F.array(F.lit("heading"), F.lit("table"), F.lit("figure"), F.lit("paragraph")), (k % 4 + 1).cast("int")).alias("type"),
        (k % 5 + 1).cast("int").alias("level"), (k % 3 > 0).alias("headed"), F.when(k % 7 > 0, "c").otherwise(" ").alias("caption"),
    )
    o = F.col("o_orderkey")
    metadata = table(spark, sf_dir, "orders").select(o.alias("doc_id"), F.lit("T").alias("title"), F.when(o % 3 > 0, "P").otherwise(" ").alias("publisher"), F.lit("2020").alias("published_date"))
    graph = table(spark, sf_dir, "orders").select(o.alias("doc_id"), F.when(o % 4 == 0, '{"@context":"https://schema.org","@graph":[{"@type":"WebPage","name":"x"},{"@type":"Report","name":"R"}]}').when(o % 4 == 1, '{"@context":"https://schema.org","@graph":[{"@type":"WebPage","name":"x"}]}').when(o % 4 == 2, '{"@context":"https://schema.org","@type":"Report","name":"R"}').otherwise("no json").alias("json"))
    return publication.full_validation(rows, metadata, graph)


def citation_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of citations in made-up lists of parts."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(publication.identifiers(publication.split_values(_citations()))).alias("place", "c"))
    return rows.select("p_partkey", "place", "c.*")


def _citations():
    k = F.col("p_partkey")
    return F.concat_ws("; ", F.when(k % 2 == 0, F.concat(F.lit("ISBN 978-0-"), (k + 100000).cast("string"), F.lit("-1-X"))), F.when(k % 3 == 0, "ISSN 1234-567X"), F.when(k % 5 == 0, F.concat(F.lit("Series: Reports, no. "), k.cast("string"))).when(k % 5 == 1, "Series: Papers"), F.when(k % 4 == 0, F.concat("p_name", F.lit(" Act 1999"))).when(k % 4 == 1, "Smith v Jones").otherwise(F.col("p_name")), F.lit(" "))


SITE = {"site_url": "https://host.example", "site_name": "Press One", "page_url": "https://host.example/{slug}/{id}", "api_url": "https://api.example/", "license_url": "https://l.example", "holder": "Holder"}


def json_ld_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graphs of parts on a site that one in three of their publishers owns: the nodes one by one, without the report's fixed fields."""
    k = F.col("p_partkey")
    parts = F.array(F.struct(F.lit("intro").alias("id"), F.lit("Intro").alias("title")), F.struct(F.lit("s-2").alias("id"), F.col("p_type").alias("title")))
    documents = table(spark, sf_dir, "part").select(
        k.cast("string").alias("doc_id"), F.col("p_name").alias("title"), F.when(k % 2 == 0, "About").alias("description"), F.when(k % 3 == 0, "Press One; Holder").when(k % 3 == 1, "Other").otherwise(" ").alias("publisher"),
        F.when(k % 2 == 0, "Victoria, Australia; Elsewhere").alias("jurisdiction"), F.lit("").alias("authors"), _citations().alias("citations"), F.when(k % 5 == 0, "18 June 2020").when(k % 5 == 1, "Spring").alias("date"),
        F.lit("2025-01-01T00:00:00+00:00").alias("generated_at"), (k % 4 == 0).alias("captioned"), F.when(k % 6 > 0, parts).otherwise(F.array().cast("array<struct<id:string,title:string>>")).alias("sections"),
    )
    made = publication.json_ld_graph(documents, **SITE).select("doc_id", F.explode(F.from_json(F.get_json_object("json", "$['@graph']"), "array<string>")).alias("node"))
    field = lambda c: F.get_json_object("node", f"$['{c}']")
    return made.select("doc_id", field("@type").alias("kind"), field("@id").alias("node_id"), *[field(c).alias(c) for c in ("name", "publisher", "datePublished", "copyrightHolder", "reportNumber", "isPartOf", "identifier", "spatialCoverage", "citation", "inLanguage", "url", "breadcrumb", "hasPart", "accessibilityFeature")])


def footnote_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("ord"), F.concat(F.when(F.col("l_partkey") % 4 == 0, "note-").otherwise("Footnote-"), (F.col("l_partkey") % 3).cast("string"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("-"), F.col("l_linenumber").cast("string"))).otherwise("")).alias("note_id"))
    return publication.footnote_targets(rows)


def figure_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("b"), F.col("l_linenumber").cast("string")).alias("block_id"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("bounds"))
    figures = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("figure-1").alias("figure"), F.concat(F.lit("b"), (F.col("o_custkey") % 7).cast("string")).alias("source_block_id"))
    return publication.figure_sources(figures, rows)


def published_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as list entries of orders: ordered, unordered and nested ones, and numbered paragraphs between them."""
    k = F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), ((F.col("l_linenumber") * 1000000 + k) * 1000 + F.col("l_suppkey")).alias("ord"), F.when(k % 5 == 0, F.concat(F.lit("1.2 Words "), k.cast("string"))).otherwise(F.concat(F.lit("Item "), k.cast("string"))).alias("text"),
        F.when(k % 5 == 0, "").when(k % 2 == 0, F.concat((k % 9).cast("string"), F.lit("."))).otherwise("•").alias("marker"), ((k % 5 > 0) & (k % 2 == 0)).alias("enumerated"), (k % 3).cast("int").alias("level"),
    )
    made = publication.published_lists(rows, ["doc_id"], "ord")
    return made.select("doc_id", "ord", "type", "text", "number", "style", "start", F.array_join(F.transform("items", lambda x: F.concat(x["level"].cast("string"), x["marker"], x["text"])), "|").alias("items"))


def cell_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    cell = lambda text, heads, side, rows, cols: F.struct(text.alias("text"), rows.cast("int").alias("row_span"), cols.cast("int").alias("col_span"), heads.alias("column_header"), side.alias("row_header"))
    no, one = F.lit(False), F.lit(1)
    grid = F.array(F.array(cell(F.col("p_brand"), k % 2 == 0, no, one, k % 3)), F.array(cell(F.col("p_name"), no, k % 5 == 0, k % 4, one), cell(F.lit("<&>"), no, no, one, one)))
    return table(spark, sf_dir, "part").select("p_partkey", rendering.cell_grid(grid, F.when(k % 7 == 0, F.col("p_type")).otherwise(" ")).alias("html"))


def nested_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The markup of the published lists of orders, with links to one footnote."""
    k = F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), ((F.col("l_linenumber") * 1000000 + k) * 1000 + F.col("l_suppkey")).alias("ord"), F.concat(F.lit("Item text 3 "), k.cast("string")).alias("text"), F.lit("").alias("marker"), (k % 2 == 0).alias("enumerated"), (k % 3).cast("int").alias("level"))
    notes = F.array(F.struct(F.lit("3").alias("number"), F.lit("footnote-3").alias("note")))
    return publication.published_lists(rows, ["doc_id"], "ord").select("doc_id", "ord", rendering.nested_list("items", "style", "start", notes).alias("html"))


QUERIES = {f.__name__: f for f in (summary_sources, publication_summaries, display_titles, reader_sections, major_headings, publication_cells, boxed_content, figures_captioned, publication_validation, citation_identifiers, json_ld_graph, footnote_targets, figure_sources, published_lists, cell_grids, nested_lists)}

_SOURCES = f"""
WITH b AS (SELECT *, trim(text) AS t, CASE WHEN label LIKE 'section_header_%' THEN label[16]::INT END AS level,
                  trim(regexp_replace(regexp_replace(lower(text), '^\\s*((chapter|section)\\s+)?([0-9]+(\\.[0-9]+)*|[a-z])([.):–—-]|\\s)+', ''), '[^a-z0-9]+', ' ', 'g')) AS bare FROM ({SUMMARY_SQL})),
h AS (SELECT doc_id, ord AS start, level AS own, list_position({WORDS}, bare) AS rank FROM b WHERE level IS NOT NULL AND list_contains({WORDS}, bare)),
e AS (SELECT h.*, coalesce((SELECT min(ord) FROM b WHERE b.doc_id = h.doc_id AND b.ord > start AND b.level <= own), 1000000000000) AS stop FROM h),
f AS (SELECT b.doc_id, start, rank, b.ord, list_filter(CASE WHEN label = 'text' THEN [t] ELSE [] END || coalesce([trim(regexp_replace(x, '^[0-9]+(\\.[0-9]+)+\\s+', '')) FOR x IN items], []), lambda x: length(x) >= 45) AS found
      FROM b JOIN e ON e.doc_id = b.doc_id AND b.ord > start AND b.ord < stop WHERE label <> 'footer'),
u AS (SELECT doc_id, start, rank, array_to_string(flatten(list(found ORDER BY ord)), '|') AS v FROM f WHERE len(found) > 0 GROUP BY 1, 2, 3),
u1 AS (SELECT doc_id, min_by(v, rank * 1000000000000 + start) AS v FROM u GROUP BY 1),
l AS (SELECT doc_id, t, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM b WHERE label = 'text' AND length(t) >= 80),
l1 AS (SELECT doc_id, string_agg(t, '|' ORDER BY ord) AS v FROM l WHERE n <= 3 GROUP BY 1),
s AS (SELECT d.doc_id, CASE WHEN u1.v IS NOT NULL THEN 'heading' WHEN l1.v IS NOT NULL THEN 'start' ELSE 'none' END AS source, coalesce(u1.v, l1.v, '') AS of
      FROM (SELECT DISTINCT doc_id FROM b) d LEFT JOIN u1 ON u1.doc_id = d.doc_id LEFT JOIN l1 ON l1.doc_id = d.doc_id)"""
_SECTIONED = f"""
WITH h AS (SELECT *, lower(regexp_replace(text, '^Chapter 1\\. ', '')) AS key FROM {HEADINGS}),
s AS (SELECT doc_id, ord, key IS DISTINCT FROM lag(key) OVER (PARTITION BY doc_id ORDER BY ord) AS starts FROM h WHERE level = 1),
n AS (SELECT h.*, coalesce(starts, false) AS starts, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY h.doc_id ORDER BY h.ord)::BIGINT AS section FROM h LEFT JOIN s ON s.doc_id = h.doc_id AND s.ord = h.ord),
t AS (SELECT doc_id, section, coalesce(min_by(text, ord) FILTER (starts), 'Front matter') AS title, count(*) AS blocks FROM n GROUP BY 1, 2)"""
_PARTS = """
SELECT *, list_filter([CASE WHEN k % 2 = 0 THEN 'ISBN 978-0-' || (k + 100000) || '-1-X' END, CASE WHEN k % 3 = 0 THEN 'ISSN 1234-567X' END, CASE k % 5 WHEN 0 THEN 'Series: Reports, no. ' || k WHEN 1 THEN 'Series: Papers' END,
       CASE k % 4 WHEN 0 THEN p_name || ' Act 1999' WHEN 1 THEN 'Smith v Jones' ELSE p_name END], lambda x: x IS NOT NULL) AS c FROM (SELECT *, p_partkey AS k FROM part)"""
_URL = "'https://host.example/' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '/' || k"
ORACLES = {
    "summary_sources": f"{_SOURCES} SELECT doc_id, source, of FROM s",
    "publication_summaries": f"{_SOURCES} SELECT doc_id, 'This publication presents the reviewed content of Document' || CASE WHEN doc_id % 2 = 0 THEN ' ' || doc_id ELSE '' END || '.' AS summary FROM s WHERE source = 'none'",
    "display_titles": f"""{_SECTIONED},
f AS (SELECT n.doc_id, n.section, min_by(n.text, n.ord) AS said, min_by(n.key, n.ord) AS key FROM n WHERE level > 1 AND section > 0 GROUP BY 1, 2)
SELECT t.doc_id, t.section, t.title, CASE WHEN key = lower(regexp_replace(t.title, '^Chapter 1\\. ', '')) THEN said ELSE t.title END AS display_title,
       t.blocks - CASE WHEN key = lower(regexp_replace(t.title, '^Chapter 1\\. ', '')) THEN 1 ELSE 0 END AS blocks FROM t LEFT JOIN f ON f.doc_id = t.doc_id AND f.section = t.section""",
    "reader_sections": f"{_SECTIONED} SELECT doc_id, section, CASE WHEN section = 0 THEN 'Document' ELSE title END AS title, blocks FROM t WHERE section > 0 OR NOT EXISTS (SELECT 1 FROM t o WHERE o.doc_id = t.doc_id AND o.section > 0)",
    "major_headings": f"SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN ord % 3 > 0 THEN ord % 100 ELSE 1000000 END, page, ord) AS place FROM {HEADINGS} WHERE level = 2",
    "publication_cells": """
WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN [[p_brand, p_type]] ELSE [] END || [[p_name, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR END, '')], [p_type]] AS rows FROM part),
x AS (SELECT p_partkey, unnest(range(len(rows)))::INT AS row, unnest(rows) AS cells FROM r)
SELECT p_partkey, row, unnest(range(len(cells)))::INT AS start_column, unnest(cells) AS text, p_partkey % 3 > 0 AND row = 0 AS column_header FROM x""",
    "boxed_content": """
WITH p AS (SELECT *, p_partkey AS k, p_partkey % 9 AS g, CASE WHEN p_partkey % 4 > 0 THEN p_size ELSE 7 END AS page FROM part)
SELECT k AS p_partkey, 0 AS at, ['list', 'table', 'figure', 'footnote', 'heading', 'formula', 'group', 'paragraph', 'paragraph'][g + 1] AS type, CASE WHEN g = 2 THEN 'Figure' WHEN g = 8 THEN 'plain' ELSE p_name END AS text,
       CASE WHEN g = 4 THEN 5 END AS level, CASE WHEN g = 7 THEN '1.2' END AS number, page FROM p WHERE k % 5 > 0 AND NOT (g = 8 AND k % 2 = 0)
UNION ALL SELECT k, 0, 'list', '- ' || p_name || chr(10) || '- ' || p_brand, NULL, NULL, 7 FROM p WHERE k % 20 = 0
UNION ALL SELECT k, i, 'paragraph', CASE WHEN i = 0 THEN p_name ELSE p_brand END, NULL, NULL, 7 FROM p, (SELECT unnest([0, 1]) AS i) WHERE k % 5 = 0 AND k % 20 > 0""",
    "figures_captioned": "SELECT l_orderkey AS doc_id, bool_and(NOT (l_partkey % 4 = 0 AND l_partkey % 8 <> 0) AND NOT (l_partkey % 2 = 1 AND l_partkey % 3 = 0 AND l_partkey % 11 = 0)) AS captioned FROM lineitem GROUP BY 1",
    "publication_validation": """
WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS section, l_linenumber * 1000000 + l_partkey AS ord, l_partkey AS k FROM lineitem),
h AS (SELECT doc_id, k % 5 + 1 > coalesce(lag(k % 5 + 1) OVER (PARTITION BY doc_id, section ORDER BY ord), 1) + 1 AS skips FROM b WHERE k % 4 = 0),
s AS (SELECT doc_id, count(*) FILTER (skips) AS n FROM h GROUP BY 1),
c AS (SELECT doc_id, count(DISTINCT section) AS sections, count(*) AS blocks, count(*) FILTER (k % 4 = 1 AND k % 3 = 0) AS t, count(*) FILTER (k % 4 = 2 AND k % 7 = 0) AS f FROM b GROUP BY 1),
x AS (SELECT o_orderkey AS doc_id, coalesce(sections, 0) AS sections, coalesce(blocks, 0) AS blocks, coalesce(n, 0) AS skipped_levels, coalesce(t, 0) AS headerless_tables, coalesce(f, 0) AS bare_figures, o_orderkey % 4 IN (0, 2) AS json_ld_valid, o_orderkey % 3 > 0 AS metadata_complete
      FROM orders LEFT JOIN c ON c.doc_id = o_orderkey LEFT JOIN s ON s.doc_id = o_orderkey)
SELECT *, blocks > 0 AND skipped_levels + headerless_tables + bare_figures = 0 AND json_ld_valid AND metadata_complete AS passed FROM x""",
    "citation_identifiers": f"""
SELECT k AS p_partkey, place, CASE WHEN v LIKE 'ISBN%' THEN 'isbn' WHEN v LIKE 'ISSN%' THEN 'issn' WHEN v LIKE 'Series%' THEN 'series' ELSE 'text' END AS kind,
       CASE WHEN v LIKE 'ISBN%' THEN v[6:] WHEN v LIKE 'ISSN%' THEN v[6:] WHEN v LIKE 'Series: Rep%' THEN 'Reports' WHEN v LIKE 'Series%' THEN 'Papers' ELSE v END AS value, CASE WHEN v LIKE 'Series: Rep%' THEN k::VARCHAR END AS number
FROM (SELECT k, unnest(range(len(c)))::INT AS place, unnest(c) AS v FROM ({_PARTS}))""",
    "json_ld_graph": f"""
WITH p AS (SELECT *, k::VARCHAR AS doc_id, {_URL} AS page, CASE WHEN k % 2 = 0 THEN 'en-AU' ELSE 'en' END AS lang, '#organization-' || k AS org, k % 3 = 0 AS owned, CASE WHEN k % 3 = 0 THEN '#organization-' || k || '-2' ELSE '#copyright-holder-' || k END AS holder FROM ({_PARTS}))
SELECT doc_id, 'Report' AS kind, 'urn:uuid:' || k AS node_id, p_name AS name,
  CASE k % 3 WHEN 0 THEN '[{{"@id":"https://host.example/#organization"}},{{"@id":"' || org || '-2"}}]' WHEN 1 THEN '[{{"@id":"' || org || '"}}]' END AS publisher,
  CASE k % 5 WHEN 0 THEN '2020-06-18' WHEN 1 THEN 'Spring' END AS "datePublished", '{{"@id":"' || holder || '"}}' AS "copyrightHolder", CASE WHEN k % 5 = 0 THEN k::VARCHAR END AS "reportNumber",
  CASE k % 5 WHEN 0 THEN '{{"@type":"CreativeWorkSeries","name":"Reports"}}' WHEN 1 THEN '{{"@type":"CreativeWorkSeries","name":"Papers"}}' END AS "isPartOf",
  CASE WHEN k % 2 = 0 OR k % 3 = 0 THEN '[' || concat_ws(',', CASE WHEN k % 2 = 0 THEN '{{"@type":"PropertyValue","propertyID":"ISBN","value":"978-0-' || (k + 100000) || '-1-X"}}' END, CASE WHEN k % 3 = 0 THEN '{{"@type":"PropertyValue","propertyID":"ISSN","value":"1234-567X"}}' END) || ']' END AS identifier,
  CASE WHEN k % 2 = 0 THEN '[{{"@type":"AdministrativeArea","name":"Victoria, Australia"}},{{"@type":"AdministrativeArea","name":"Elsewhere"}}]' END AS "spatialCoverage",
  '[' || CASE k % 4 WHEN 0 THEN '{{"@type":"Legislation","name":"' || p_name || ' Act 1999"}}' WHEN 1 THEN '{{"@type":"CreativeWork","name":"Smith v Jones"}}' ELSE '"' || p_name || '"' END || ']' AS citation, lang AS "inLanguage", NULL AS url, NULL AS breadcrumb,
  CASE WHEN k % 6 > 0 THEN '[' || array_to_string(['{{"@type":"Chapter","@id":"urn:uuid:' || k || '#' || x.i || '","isPartOf":{{"@id":"urn:uuid:' || k || '"}},"name":"' || x.t || '","position":' || x.n || ',"url":"' || page || '#' || x.i || '"}}' FOR x IN [{{'i': 'intro', 't': 'Intro', 'n': 1}}, {{'i': 's-2', 't': p_type, 'n': 2}}]], ',') || ']' END AS "hasPart",
  '["structuralNavigation","tableOfContents","readingOrder"' || CASE WHEN k % 4 = 0 THEN ',"alternativeText"' ELSE '' END || ']' AS "accessibilityFeature" FROM p
UNION ALL SELECT doc_id, 'WebPage', page, p_name || ' - Press One', NULL, '2025-01-01T00:00:00+00:00', NULL, NULL, '{{"@id":"https://host.example/#website"}}', NULL, NULL, NULL, lang, page, '{{"@id":"' || page || '#breadcrumb"}}', NULL, NULL FROM p
UNION ALL SELECT doc_id, 'ImageObject', page || '#primaryimage', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'https://api.example/api/documents/' || k || '/cover', NULL, NULL, NULL FROM p
UNION ALL SELECT doc_id, 'Organization', CASE WHEN owned THEN 'https://host.example/#organization' ELSE org END, CASE WHEN owned THEN 'Press One' ELSE 'Other' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN owned THEN 'https://host.example/' END, NULL, NULL, NULL FROM p WHERE k % 3 < 2
UNION ALL SELECT doc_id, 'Organization', holder, 'Holder', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p
UNION ALL SELECT doc_id, 'WebSite', 'https://host.example/#website', 'Press One', CASE WHEN owned THEN '[{{"@id":"https://host.example/#organization"}}]' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, lang, 'https://host.example/', NULL, NULL, NULL FROM p
UNION ALL SELECT doc_id, 'BreadcrumbList', page || '#breadcrumb', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p""",
    "footnote_targets": "SELECT l_orderkey AS doc_id, (l_partkey % 3)::VARCHAR AS number, min_by('Footnote-' || (l_partkey % 3) || CASE WHEN l_suppkey % 2 = 0 THEN '-' || l_linenumber ELSE '' END, (l_linenumber * 1000000 + l_partkey) * 1000 + l_suppkey) AS note_id FROM lineitem WHERE l_partkey % 4 > 0 GROUP BY 1, 2",
    "figure_sources": "SELECT o_orderkey AS doc_id, 'figure-1' AS figure, 'b' || l_linenumber AS source_block_id, l_linenumber AS page, l_partkey AS bounds, sha256('b' || l_linenumber)[1:16] AS image_key FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = o_custkey % 7",
    "published_lists": """
WITH i AS (SELECT l_orderkey AS doc_id, (l_linenumber * 1000000 + l_partkey) * 1000 + l_suppkey AS ord, l_partkey AS k, l_partkey % 5 = 0 AS par, l_partkey % 2 = 0 AS o, l_partkey % 3 AS level FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM (SELECT DISTINCT * FROM i)),
f AS (SELECT a.*, (SELECT max(b.n) FROM n b WHERE b.doc_id = a.doc_id AND b.n < a.n AND b.par) AS after_par FROM n a),
g AS (SELECT a.*, (SELECT max_by(b.o, b.n) FROM f b WHERE b.doc_id = a.doc_id AND b.n < a.n AND b.n > coalesce(a.after_par, 0) AND (b.level = 0 OR b.n = coalesce(b.after_par, 0) + 1)) AS was FROM f a),
r AS (SELECT *, sum(CASE WHEN par OR n = coalesce(after_par, 0) + 1 OR level = 0 AND was IS NOT NULL AND was <> o THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM g)
SELECT doc_id, min(ord) AS ord, CASE WHEN bool_or(par) THEN 'paragraph' ELSE 'list' END AS type, CASE WHEN bool_or(par) THEN 'Words ' || min(k) END AS text, CASE WHEN bool_or(par) THEN '1.2' END AS number,
       CASE WHEN NOT bool_or(par) THEN CASE WHEN min_by(o, n) THEN 'ordered' ELSE 'unordered' END END AS style, CASE WHEN NOT bool_or(par) THEN min_by(CASE WHEN k % 9 = 0 THEN 1 ELSE k % 9 END, n) FILTER (o) END::INT AS start,
       CASE WHEN NOT bool_or(par) THEN string_agg(level || CASE WHEN o THEN (k % 9) || '.' ELSE '•' END || 'Item ' || k, '|' ORDER BY n) END AS items
FROM r GROUP BY doc_id, run""",
    "cell_grids": """
SELECT k AS p_partkey, '<table>' || CASE WHEN k % 7 = 0 THEN '<caption>' || p_type || '</caption>' ELSE '' END || '<tr><' || CASE WHEN k % 2 = 0 THEN 'th scope="col"' ELSE 'td' END || CASE WHEN k % 3 = 2 THEN ' colspan="2"' ELSE '' END || '>' || p_brand || CASE WHEN k % 2 = 0 THEN '</th>' ELSE '</td>' END
  || '</tr><tr><' || CASE WHEN k % 5 = 0 THEN 'th scope="row"' ELSE 'td' END || CASE WHEN k % 4 > 1 THEN ' rowspan="' || (k % 4) || '"' ELSE '' END || '>' || p_name || CASE WHEN k % 5 = 0 THEN '</th>' ELSE '</td>' END || '<td>&lt;&amp;&gt;</td></tr></table>' AS html
FROM (SELECT *, p_partkey AS k FROM part)""",
}
