"""Queries over contents pages, outlines, assembled blocks, records and metadata as a whole."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pageloom.functions import geometry, tables, text
from pageloom.operators import audit, blocks, contents, contents_rows, hierarchy, metadata, sequential
from pageloom.plans.inputs import RECORDS_SQL, duck, records, table
from pageloom.plans.layout_queries import BOX_SQL, _boxes
from pageloom.sources import layouts
from pageloom.sources import records as stored

RECORDS = duck(RECORDS_SQL)


#: Line items as lines of contents pages, an order a page, in six layouts: dotted rows; pages apart on the right; pages apart on the left; titles
#: that wrap, the page on their last line; two columns with pages apart; chapters without a page above dotted rows, some of which go on below.
CONTENTS_SQL = """
SELECT doc_id, nth, lay, pos, text, l, t, l + 5.0 * length(text) AS r, t + 10.0 AS b FROM (
  SELECT doc_id, nth, lay, 2 * nth AS pos, 80.0 + 40.0 * (CASE WHEN lay = 4 THEN floor((nth - 1) / 2) ELSE nth END) + CASE WHEN lay = 3 AND k % 2 = 0 THEN 12.0 ELSE 0.0 END AS t,
         CASE lay WHEN 2 THEN 120.0 WHEN 4 THEN 60.0 + 270.0 * ((nth - 1) % 2) ELSE 70.0 END AS l,
         CASE WHEN lay IN (0, 3) THEN 'Topic ' || k || ' of law ..... ' || nth WHEN lay = 5 AND nth % 3 = 1 THEN 'Chapter ' || nth || ': Law ' || k WHEN lay = 5 THEN 'Topic ' || k || ' ..... ' || nth ELSE 'Topic ' || k || ' of law' END AS text
  FROM items
  UNION ALL
  SELECT doc_id, nth, lay, 2 * nth - 1 AS pos, 80.0 + 40.0 * (CASE WHEN lay = 4 THEN floor((nth - 1) / 2) ELSE nth END) + CASE WHEN lay = 5 THEN 13.0 ELSE 0.0 END AS t,
         CASE lay WHEN 1 THEN 500.0 WHEN 2 THEN 60.0 WHEN 4 THEN 250.0 + 270.0 * ((nth - 1) % 2) ELSE 75.0 END AS l, CASE WHEN lay IN (3, 5) THEN 'On part ' || k || ' and' ELSE CAST(nth AS STRING) END AS text
  FROM items WHERE lay IN (1, 2, 4) OR (lay = 3 AND k % 2 = 0) OR (lay = 5 AND nth % 3 = 2 AND k % 2 = 0)) x"""


def contents_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.count("*").over(Window.partitionBy("l_orderkey"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("k"), F.row_number().over(_by_order()).alias("nth"), (F.col("l_orderkey") % 6).alias("lay"), held.alias("held"))
    lines = spark.sql(CONTENTS_SQL.replace("FROM items", "FROM {items}").replace("doc_id, nth, lay", "doc_id, nth, lay, held"), items=items)
    height = F.greatest(F.lit(842.0), 150.0 + 40.0 * F.col("held"))  # a page holds all its lines: from 18 items on they reach below 842 points
    return lines.select("doc_id", F.lit(1).alias("page"), "pos", "text", *"ltrb", F.lit(10.0).alias("size"), F.lit(False).alias("prominent"), F.lit(595.0).alias("page_width"), height.alias("page_height"))


def _by_order():
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents_rows.page_entries(contents_lines(spark, sf_dir)).select("doc_id", "ord", "title", "printed", "level")


#: Line items as parts of a layout: members of a list, texts, and texts that are left out.
PARTS_SQL = "SELECT l_orderkey AS doc_id, l_partkey AS k, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS n FROM {lineitem}"


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts as JSON, an order each, read again and made into blocks: texts, a list, and a table with a caption, a header row in every other one and all cells in its grid in every third."""
    parts = spark.sql(PARTS_SQL, lineitem=table(spark, sf_dir, "lineitem"))
    prov = lambda top: F.array(F.struct(F.lit(1).alias("page_no"), F.struct(F.lit(10.0).alias("l"), top.cast("double").alias("t"), F.lit(90.0).alias("r"), (top - 5).cast("double").alias("b"), F.lit("BOTTOMLEFT").alias("coord_origin")).alias("bbox")))
    ref = F.concat(F.lit("#/texts/"), F.col("n").cast("string"))
    text = F.struct("n", ref.alias("self_ref"), F.when(F.col("k") % 4 == 0, "list_item").otherwise("text").alias("label"), F.concat(F.lit(" Part "), F.col("k").cast("string")).alias("text"), F.when(F.col("k") % 8 == 0, "1.").alias("marker"), (F.col("k") % 8 == 0).alias("enumerated"), (F.col("k") % 3).cast("int").alias("level"), prov(800 - 20 * F.col("n")).alias("prov"), F.struct((F.col("k") % 4 == 3).cast("string").alias("exclude_from_output")).alias("meta"))
    cell = F.struct("n", F.lit(0).alias("start_col_offset_idx"), F.col("n").alias("start_row_offset_idx"), F.concat(F.lit("c"), F.col("k").cast("string")).alias("text"), ((F.col("doc_id") % 2 == 0) & (F.col("n") == 0)).alias("column_header"))
    held = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(text)).alias("texts"), F.array_sort(F.collect_list(cell)).alias("cells"), F.array_sort(F.collect_list(F.when(F.col("k") % 4 == 0, F.struct("n", ref.alias("$ref"))))).alias("children"), F.count("*").alias("size"))
    grid = F.when(F.col("doc_id") % 3 == 0, F.array("cells"))
    shape = F.struct(F.when(F.col("doc_id") % 5 == 0, F.col("size") + 1).cast("int").alias("num_rows"), F.lit(2).alias("num_cols"), F.when(grid.isNull(), F.col("cells")).alias("table_cells"), grid.alias("grid"))
    made = held.select("doc_id", F.concat(F.lit("order_"), F.col("doc_id").cast("string")).alias("name"), "texts", F.when(F.size("children") > 0, F.array(F.struct(F.lit("#/groups/0").alias("self_ref"), F.lit("list").alias("label"), "children"))).alias("groups"), F.array(F.struct(F.lit("#/tables/0").alias("self_ref"), F.lit("table").alias("label"), prov(F.lit(100.0)).alias("prov"), F.array(F.struct(F.lit("#/texts/0").alias("$ref"))).alias("captions"), shape.alias("data"))).alias("tables"), F.create_map(F.lit("1"), F.struct(F.struct(F.lit(595.0).alias("width"), F.when(F.col("doc_id") % 7 > 0, 842.0).otherwise(0.0).alias("height")).alias("size"))).alias("pages"))
    read = layouts.typed(made.select("doc_id", F.to_json(F.struct(*made.columns[1:])).alias("json")))
    sure = parts.select("doc_id", ref.alias("ref"), (F.col("k") % 10 / 10).alias("confidence"))
    found = layouts.layout_blocks(read, sure, parts.select("doc_id", ref.alias("ref")).limit(0))
    flat = lambda c, f: F.array_join(F.transform(c, f), "~")
    return found.select("doc_id", "ord", "block_id", "label", "text", "confidence", "table_data.caption", flat("table_data.headers", lambda h: h).alias("headers"), F.size("table_data.rows").alias("rows"), flat("list_entries", lambda e: F.concat_ws(":", e["marker"], e["text"], e["level"].cast("string"))).alias("entries"), "bounds.t", "bounds.b")


def heading_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    forms = [F.col("p_name"), F.lit("Recommendations"), F.concat(F.lit("1.2.3 "), "p_name"), F.concat(F.lit("Figure "), k.cast("string"), F.lit(": x")), F.lit("Appendix IV Lists"), F.lit("Glossary of terms"), F.lit("Published by us"), F.lit("2.1) Law")]
    title = F.concat(F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int")), F.when(k % 3 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(name) for name, c in hierarchy.heading_classes(title).items()])


def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir)
    reason = geometry.exclusion_reason(geometry.outside_page(F.col("box"), F.lit(80.0), F.lit(70.0)), F.col("l_partkey") % 5 == 0, F.col("l_partkey") % 3 == 0)
    return rows.groupBy(F.coalesce(reason, F.lit("none")).alias("reason")).agg(F.count("*").alias("items"))


def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    before = F.create_map(F.lit("title"), F.col("o_orderpriority"), F.lit("publisher"), F.when(k % 3 > 0, F.col("o_orderstatus")))
    after = F.create_map(F.lit("title"), F.when(k % 2 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")), F.lit("publisher"), F.col("o_orderstatus"), F.lit("note"), F.when(k % 5 == 0, "new"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(",", F.map_keys(audit.changed_fields(before, after))).alias("changed"))


def callouts_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as blocks of pages with three regions that overlap: which region's heading each block stands under."""
    rows = _boxes(spark, sf_dir)
    made = rows.select("doc_id", "page", F.concat_ws("-", "l_linenumber", "l_partkey", (F.col("box.t")).cast("int").cast("string")).alias("block_id"), (F.col("ord") * 1000 + F.col("box.t")).cast("long").alias("order"), F.when(F.col("l_partkey") % 3 == 0, "section_header_3").otherwise("text").alias("label"), F.lit("A heading").alias("text"), (F.col("l_partkey") % 100 / 100).alias("confidence"), ((F.col("box.l") + F.col("box.r")) / 2).alias("x"), ((F.col("box.t") + F.col("box.b")) / 2).alias("y"))
    thirds = F.array(*[F.struct(F.lit(k).alias("region"), F.lit(30.0 * k).alias("l"), F.lit(0.0).alias("t"), F.lit(30.0 * k + 45).alias("r"), F.lit(60.0).alias("b")) for k in range(3)])
    regions = rows.select("doc_id", "page").distinct().select("doc_id", "page", F.explode(thirds).alias("h")).select("doc_id", "page", "h.*")
    return sequential.page_callouts(made, regions)


def table_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of parts as the pages show them: lines at pipes, marked lines, one line, and back into a table without regard to tabs."""
    k = F.col("p_partkey")
    first = F.element_at(F.array(F.lit("iv"), F.lit("(2)"), F.lit("3."), F.col("p_name")), (k % 4 + 1).cast("int"))
    made = F.struct(F.array(F.lit("Column 1"), F.lit("Size")).alias("headers"), F.when(k % 5 > 0, F.array(F.array(first, F.col("p_size").cast("string")), F.array(F.lit(" "), F.lit("|")))).otherwise(F.array().cast("array<array<string>>")).alias("rows"))
    text = F.concat(F.lit("1) "), "p_name", F.lit("\n  • a\tb\n\niv. "), "p_brand")
    back = tables.table_of(F.concat("p_name", F.lit("\tx\n"), "p_brand", F.lit(" | y")), tabs=False)
    return table(spark, sf_dir, "part").select("p_partkey", tables.piped_lines(made).alias("piped"), tables.marked_lines(made).alias("marked"), tables.bare_line(text).alias("bare"), F.array_join(back["headers"], "~").alias("headers"))


def file_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    info = F.when(k % 9 > 0, F.create_map(F.lit("title"), F.concat(F.lit("## "), "p_name", F.lit("  x | ")), F.lit("author"), F.when(k % 2 == 0, F.lit(" <!-- no --> ")).otherwise(F.col("p_brand")), F.lit("subject"), F.lit(None).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(metadata.cleaned_info(info)).alias("info"))


def metadata_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of orders, of which some fields were found, as values and evidence."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders")
    one = lambda name, value, page, score: F.struct(F.lit(name).alias("field"), value.alias("value"), page.cast("int").alias("page"), F.lit("rule").alias("method"), score.alias("confidence"))
    found = rows.select(k.alias("doc_id"), F.explode(F.array(one("title", F.col("o_orderpriority"), k % 8 + 1, F.lit(0.9)), one("publisher", F.lit("Press "), F.when(k % 2 == 0, 2), k % 10 / 10))).alias("f")).select("doc_id", "f.*")
    made = metadata.metadata_payload(rows.select(k.alias("doc_id")), found)
    shown = [F.concat_ws("|", *[F.col(f"fields.{f}.{c}").cast("string") for c in ("band", "page", "evidence", "source")]).alias(f) for f in ("title", "publisher", "citations")]
    return made.select("doc_id", F.map_values("metadata").alias("v"), "metadata", "fields").select("doc_id", F.size("v").alias("values"), F.col("metadata.publisher").alias("press"), *shown)


def dates_with_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of parts by the lines they have: a © year, or none, with subjects and file names to fall back on."""
    k = F.col("p_partkey")
    lines = table(spark, sf_dir, "part").where(k % 3 > 0).select(k.alias("doc_id"), F.lit(1).alias("page"), F.lit(0).cast("bigint").alias("pos"), F.when(k % 3 == 1, F.concat(F.lit("© Us, "), (1990 + k % 20).cast("string"))).otherwise(F.col("p_name")).alias("line"))
    known = table(spark, sf_dir, "part").select(k.alias("doc_id"), F.when(k % 4 == 0, "Made in May 2011").alias("subject"), F.concat(F.lit("in/report-"), F.when(k % 5 > 0, "2007").otherwise("20070"), F.lit(".v1.pdf")).alias("file_name"))
    return metadata.dates_of(lines, known)


def record_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with changes of every third laid over them, and a new one for each nation."""
    old = records(spark, sf_dir).select("id", "title", "publisher")
    changes = old.where("substr(id, 5) % 3 = 0").select("id", F.lit(None).cast("string").alias("title"), F.lit("Press").alias("publisher"))
    new = table(spark, sf_dir, "nation").select(F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("title"), F.lit(None).cast("string").alias("publisher"))
    return stored.upserted(old, changes.union(new))


def finished_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select("id", "title", "publisher", F.col("state").alias("job_state"), F.lit(3).alias("job_step"), F.lit("Reading").alias("job_message"), F.lit(0).cast("bigint").alias("job_ms"), "record_key")
    outputs = rows.where("record_key % 2 = 0").select("id", F.when(F.col("record_key") % 4 == 0, "Found").otherwise("").alias("title"), F.lit(None).cast("string").alias("publisher"), (F.col("record_key") / 7).alias("seconds"))
    return stored.finished(rows.drop("record_key"), outputs)


def deleted_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of orders after those that approval makes, and page images, have gone from every other order."""
    names = ("source.pdf", "publication.json", "page-12.png", "page_1.png", "blocks.json")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.explode(F.array(*[F.lit(n) for n in names])).alias("name"), F.lit("v").alias("value"))
    return stored.artifacts_deleted(rows, rows.where("document_id % 2 = 0"), (*stored.GENERATED, "page-*.png", "*.pdf")).select("document_id", "name")


def assembled_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: every item is a text, a heading or the member of a list, and every fifth is left out or on a contents page."""
    k, o = F.col("l_partkey"), F.col("l_orderkey")
    base = table(spark, sf_dir, "lineitem").select(o.alias("doc_id"), F.row_number().over(_by_order()).alias("ord"), k.alias("k"), F.col("l_linenumber").alias("page"))
    texts = base.select("doc_id", F.concat(F.lit("t"), F.col("ord").cast("string")).alias("ref"), F.lit("texts").alias("collection"), "ord", F.when(F.col("k") % 4 == 0, "list_item").when(F.col("k") % 4 == 1, "section_header").when(F.col("k") % 4 == 2, "page_footer").otherwise("paragraph").alias("label"), F.when(F.col("k") % 7 == 0, " ").otherwise(F.concat(F.lit("Words "), F.col("k").cast("string"))).alias("text"), "page", F.lit(1).alias("level"), F.when(F.col("k") % 8 == 0, "1.").alias("marker"), F.lit("").alias("caption"), (F.col("k") % 5 == 0).alias("excluded"))
    heads = base.where("k % 4 = 0").select("doc_id").distinct().select("doc_id", F.lit("list").alias("ref"), F.lit("groups").alias("collection"), F.lit(0).alias("ord"), F.lit("list").alias("label"), F.lit("").alias("text"), F.lit(1).cast("bigint").alias("page"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("marker"), F.lit("").alias("caption"), F.lit(False).alias("excluded"))
    items = texts.unionByName(heads)
    edges = texts.where("label = 'list_item'").select("doc_id", F.lit("list").alias("parent"), F.col("ref").alias("child"), F.col("ord").alias("child_ord"))
    sure = texts.select("doc_id", "ref", (F.col("ord") / 10).alias("confidence"))
    on_contents = texts.where("ord = 3").select("doc_id", "ref")
    names = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit("the_name").alias("name"))
    return blocks.assembled(items, edges, sure, on_contents, names).select("doc_id", "block_id", "label", "text", "confidence")


def outline_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of orders as blocks, and headings for every page put in before what stands lower."""
    rows = _boxes(spark, sf_dir).select("doc_id", "ord", F.concat(F.lit("b"), F.col("ord").cast("string"), F.lit("-"), F.col("box.t").cast("int").cast("string")).alias("block_id"), "page", F.col("box.t").alias("top"), F.lit("text").alias("label"), F.lit("x").alias("text"), F.lit(0.5).alias("confidence"))
    pages = rows.select("doc_id", "page").distinct()
    entries = pages.select("doc_id", F.col("page").cast("bigint").alias("sequence"), F.concat(F.lit("Part "), F.col("page").cast("string")).alias("title"), F.lit(1).alias("level"), F.col("page").alias("target"), F.lit(30.0).alias("target_top"), F.lit(None).cast("string").alias("block_id"))
    return contents.merged_outline(rows, entries).groupBy("doc_id", "page").agg(F.min(F.when(F.col("label") != "text", F.col("ord"))).alias("heading_at"), F.min("ord").alias("first_at"), F.count("*").alias("blocks"))


def without_local_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    rows = _boxes(spark, sf_dir).select("doc_id", "page", (F.col("ord") * 1000 + F.col("box.t")).alias("ord"), F.when(k % 4 == 0, "list").when(k % 4 == 1, "footer").otherwise("text").alias("label"), F.when(k % 4 == 2, "Contents").otherwise("words").alias("text"))
    return contents.without_local_contents(rows).groupBy("doc_id").agg(F.count("*").alias("blocks"))


def heading_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir)
    items = rows.where("l_linenumber % 2 = 1").select("doc_id", "page", F.concat_ws("-", "l_linenumber", "l_partkey", F.col("box.t").cast("int").cast("string")).alias("ref"), "box")
    spans = rows.where("l_linenumber % 2 = 0").select("doc_id", "page", "box", (F.col("l_partkey") % 40 / 3).alias("size"), F.when(F.col("l_partkey") % 2 == 0, "Serif-Bold").otherwise("Serif").alias("font"), F.lit(0).alias("flags"))
    return contents.heading_styles(items, spans).select("doc_id", "ref", "size").distinct()


@F.arrow_udf(T.StringType())
def _tree(levels):
    return pa.array([" ".join(f"{d}:{p}" for d, p in sequential.list_tree(list(own))) for own in levels.to_pylist()], pa.string())


def list_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and parent of the items of nested lists, their levels made of line items."""
    levels = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: (x["l_partkey"] % 4).cast("int"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(levels.alias("levels")).select("l_orderkey", _tree("levels").alias("tree"))


def list_item_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as list items in two columns that are far apart; those of some parts have no box."""
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("list").alias("list_id"), (F.col("l_linenumber") % 2 + 1).alias("page"), ((F.col("l_linenumber") * 1000000 + k) * 1000 + s).alias("ord"), F.when(k % 5 > 0, k % 2 * 300 + k % 7).alias("l"), F.when(k % 5 > 0, s % 50).alias("t"), F.lit(595).alias("page_width"))
    return sequential.list_order(rows).select("doc_id", "ord", "place").distinct()


def list_entry_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked lines as publications and as the review page take them."""
    k = F.col("p_partkey")
    line = F.concat(F.lit("  "), F.element_at(F.array(*[F.lit(m) for m in MARKS]), (k % len(MARKS) + 1).cast("int")), F.when(k % 13 == 0, "").otherwise(F.col("p_name")), F.lit(" \t"))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.published_entry(line).alias("p"), text.shown_entry(line).alias("s"))
    return rows.select("p_partkey", F.col("p.text").alias("text"), F.col("p.marker").alias("marker"), F.col("p.value").alias("value"), F.col("s.text").alias("shown_text"), F.col("s.marker").alias("shown_marker"), F.col("s.value").alias("shown_value"))


MARKS = ("12. ", "(3) ", "(4. ", "iv) ", "• ", "· ", "no ")


QUERIES = {f.__name__: f for f in (page_entries, layout_blocks, heading_classes, exclusion_reasons, changed_fields, callouts_by_page, table_twins, file_information, metadata_payload, dates_with_fallbacks, record_upserts, finished_records, deleted_artifacts, assembled_blocks, outline_in_blocks, without_local_contents, heading_styles, list_trees, list_item_order, list_entry_variants)}

_NTH = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth FROM lineitem"
_CLAIMED = f"b0 AS (SELECT doc_id, page, concat_ws('-', l_linenumber, l_partkey, t::INT) AS id, (ord * 1000 + t)::BIGINT AS o, l_partkey % 3 = 0 AS heads, l_partkey % 100 / 100 AS sure, (l + r) / 2 AS x, (t + b) / 2 AS y, NULL::BIGINT AS under FROM ({BOX_SQL}))"
for _k in range(3):  # each region takes what the ones before it have left
    _CLAIMED += f""",
i{_k} AS (SELECT * FROM b{_k} WHERE under IS NULL AND x BETWEEN {30 * _k - 3} AND {30 * _k + 48} AND y BETWEEN -3 AND 63),
f{_k} AS (SELECT i.doc_id, i.page, h.o AS head FROM i{_k} i JOIN (SELECT doc_id, page, min(o) AS o FROM i{_k} WHERE heads GROUP BY 1, 2) h ON h.doc_id = i.doc_id AND h.page = i.page AND i.o >= h.o GROUP BY 1, 2, 3 HAVING count(*) >= 2),
b{_k + 1} AS (SELECT b.* EXCLUDE (under), CASE WHEN i.id IS NOT NULL THEN f.head ELSE b.under END AS under FROM b{_k} b LEFT JOIN f{_k} f ON f.doc_id = b.doc_id AND f.page = b.page LEFT JOIN i{_k} i ON i.doc_id = b.doc_id AND i.page = b.page AND i.id = b.id AND i.o = b.o AND b.o >= f.head)"""
ORACLES = {
    "callouts_by_page": f"""
WITH {_CLAIMED}, h AS (SELECT doc_id, page, under, min(sure) AS sure FROM b3 WHERE under IS NOT NULL GROUP BY 1, 2, 3),
e AS (SELECT b3.*, under = o AS is_head, (SELECT any_value(id) FROM b3 z WHERE z.doc_id = b3.doc_id AND z.page = b3.page AND z.o = b3.under) AS head_id FROM b3)
SELECT e.doc_id, e.page, CASE WHEN is_head THEN 'box-section:' ELSE '' END || id AS block_id, CASE WHEN e.under <> o THEN 'box-section:' || head_id END AS parent, CASE WHEN is_head THEN 'box_section' WHEN heads THEN 'section_header_3' ELSE 'text' END AS label,
       CASE WHEN e.under IS NULL OR is_head THEN (count(*) FILTER (e.under IS NULL OR is_head) OVER (PARTITION BY e.doc_id, e.page ORDER BY o) - 1)::INT END AS place, CASE WHEN is_head THEN h.sure ELSE e.sure END AS confidence
FROM e LEFT JOIN h ON h.doc_id = e.doc_id AND h.page = e.page AND h.under = e.under""",
    "page_entries": f"""
WITH items AS (SELECT l_orderkey AS doc_id, l_partkey AS k, nth, l_orderkey % 6 AS lay FROM ({_NTH})),
lines AS ({duck(CONTENTS_SQL)}),
parts AS (SELECT *, (t + b) / 2 AS m, regexp_full_match(text, '[0-9]{{1,4}}') AS alone, nullif(regexp_extract(text, '^(.+?) *[.]{{2,}} *([0-9]+)$', 1), '') AS title, regexp_extract(text, '^(.+?) *[.]{{2,}} *([0-9]+)$', 2) AS printed FROM lines),
paired AS (SELECT n.doc_id, n.text AS printed, arg_min(x.text, abs(CASE WHEN n.l < 160 THEN x.l - n.r ELSE n.l - x.r END)) AS title, min(least(x.l, n.l)) FILTER (n.l < 160) AS led, arg_min(x.l, abs(n.l - x.r)) AS l, n.t
           FROM parts n JOIN parts x ON x.doc_id = n.doc_id AND n.alone AND NOT x.alone AND x.title IS NULL AND abs(x.m - n.m) <= 4.8 AND CASE WHEN n.l < 160 THEN x.l >= n.r - 3 ELSE x.r <= n.l + 3 END GROUP BY n.doc_id, n.pos, n.text, n.l, n.t),
texts AS (SELECT * FROM parts WHERE NOT alone AND title IS NULL AND text NOT LIKE 'Topic %'),
whole AS (SELECT p.doc_id, p.printed, concat_ws(' ', u.text, p.title, d.text) AS title, p.l, coalesce(u.t, p.t) AS t
          FROM parts p LEFT JOIN texts u ON u.doc_id = p.doc_id AND p.t - u.b BETWEEN -2 AND 3.5 LEFT JOIN texts d ON d.doc_id = p.doc_id AND d.t - p.b BETWEEN -2 AND 5.5 AND d.text NOT LIKE 'Chapter %' WHERE p.title IS NOT NULL),
opened AS (SELECT doc_id, NULL AS printed, text AS title, l, t FROM texts WHERE text LIKE 'Chapter %'),
every AS (SELECT doc_id, printed, title, coalesce(led, l) AS l, t FROM paired UNION ALL SELECT * FROM whole UNION ALL SELECT * FROM opened)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY l > 200, t, l) - 1)::INT AS ord, title, printed, CASE WHEN title LIKE 'Chapter %' THEN 1 ELSE 2 END AS level FROM every""",
    "layout_blocks": f"""
WITH p AS ({PARTS_SQL.replace("{lineitem}", "lineitem")}),
x AS (SELECT *, 'Part ' || k AS word, n::DOUBLE AS rank FROM p),
m AS (SELECT * FROM x WHERE k % 4 = 0),
b AS (SELECT doc_id, rank, '#/texts/' || n AS block_id, 'text' AS label, word AS text, k % 10 / 10 AS confidence, NULL AS entries, 42 + 20 * n AS t, 47 + 20 * n AS b FROM x WHERE k % 4 IN (1, 2)
      UNION ALL SELECT doc_id, min(n) - 0.25, '#/groups/0', 'list', string_agg(CASE WHEN k % 8 = 0 THEN '1. ' ELSE '• ' END || word, chr(10) ORDER BY n), min(k % 10 / 10), string_agg(CASE WHEN k % 8 = 0 THEN '1.' ELSE '' END || ':' || word || ':' || k % 3, '~' ORDER BY n), 42 + 20 * min(n), 47 + 20 * max(n) FROM m GROUP BY 1
      UNION ALL SELECT DISTINCT doc_id, -1, '#/synthetic/document-title', 'title', 'order ' || doc_id, 1, NULL, NULL, NULL FROM p),
tab AS (SELECT doc_id, 1000 AS rank, count(*) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS n_rows, list('c' || k ORDER BY n) AS cs, arg_min(k, n) AS first_k FROM p GROUP BY 1),
tb AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN cs[1] || '~' ELSE 'Column 1~Column 2' END AS headers, [c || ' | ' FOR c IN cs] AS ls FROM tab)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rank) - 1 AS ord, block_id, label, text, confidence::DOUBLE AS confidence, caption, headers, rows, entries, CASE WHEN doc_id % 7 > 0 THEN t END::DOUBLE AS t, CASE WHEN doc_id % 7 > 0 THEN b END::DOUBLE AS b FROM (
  SELECT doc_id, rank, block_id, label, text, confidence, NULL AS caption, NULL AS headers, NULL AS rows, entries, t, b FROM b
  UNION ALL SELECT doc_id, rank, '#/tables/0', 'table', CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'Column 1 | Column 2' || chr(10) END || array_to_string(ls, chr(10)), NULL, 'Part ' || first_k, headers, n_rows - CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END, NULL, 742, 747 FROM tb) q""",
    "heading_classes": """
WITH t AS (
  SELECT p_partkey, [p_name, 'Recommendations', '1.2.3 ' || p_name, 'Figure ' || p_partkey || ': x', 'Appendix IV Lists', 'Glossary of terms', 'Published by us', '2.1) Law'][p_partkey % 8 + 1] || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_size ELSE '' END AS t FROM part),
n AS (SELECT *, lower(t) AS low, regexp_extract(t, '^([0-9]+([.][0-9]+)+)[.)]? +[^ ].*$', 1) AS number FROM t)
SELECT p_partkey, regexp_full_match(low, 'recommendations?|case stud(y|ies)( [0-9]+)?|example|note') AS is_panel, NOT regexp_matches(low, '^((figure|table) [0-9]+ *[:.]|(published|printed|ordered) by )') AS is_body, regexp_matches(low, '^appendix ([a-z]|[0-9]+|[ivxlcdm]+) ') AS is_appendix,
       regexp_full_match(low, 'appendices|glossary( of .*)?|bibliography|references|index') AS always_top, nullif(number, '') AS body_number, CASE WHEN number <> '' THEN len(string_split(number, '.')) END::INT AS depth FROM n""",
    "exclusion_reasons": f"""
SELECT CASE WHEN r > 83 OR b > 73 THEN 'text positioned outside the visible PDF page' WHEN l_partkey % 5 = 0 THEN 'repeated decorative fragment' WHEN l_partkey % 3 = 0 THEN 'watermark or decorative background text' ELSE 'none' END AS reason, count(*) AS items
FROM ({BOX_SQL}) GROUP BY 1""",
    "changed_fields": "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 2 = 0 AND lower(o_orderpriority) <> o_orderpriority THEN 'title' END, CASE WHEN o_orderkey % 3 = 0 THEN 'publisher' END, CASE WHEN o_orderkey % 5 = 0 THEN 'note' END) AS changed FROM orders",
    "table_twins": """
WITH p AS (SELECT *, p_partkey AS k, ['iv', '(2)', '3.', p_name][p_partkey % 4 + 1] AS first FROM part)
SELECT k AS p_partkey, 'Column 1 | Size' || CASE WHEN k % 5 > 0 THEN chr(10) || first || ' | ' || p_size ELSE '' END AS piped,
       CASE WHEN k % 5 = 0 THEN 'Size' ELSE CASE k % 4 WHEN 0 THEN 'iv. ' || p_size WHEN 3 THEN p_name || ' — ' || p_size ELSE first || ' ' || p_size END || chr(10) || '|' END AS marked,
       p_name || ' a b iv. ' || p_brand AS bare, p_name || chr(9) || 'x~' AS headers FROM p""",
    "file_information": """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '{}' ELSE '{"title":"' || p_name || ' x"' || CASE WHEN p_partkey % 2 = 1 THEN ',"author":"' || p_brand || '"' ELSE '' END || '}' END AS info FROM part""",
    "metadata_payload": """
SELECT o_orderkey AS doc_id, 5 AS values, 'Press' AS press, 'high|' || (k % 8 + 1) || '|Rule-based extraction matched “' || o_orderpriority || '”.|Extracted text · page ' || (k % 8 + 1) || ' · rule' AS title,
       CASE WHEN k % 10 >= 8 THEN 'high' WHEN k % 10 >= 6 THEN 'med' ELSE 'low' END || '|' || CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END || '|Rule-based extraction matched “Press”.|Extracted text · ' || CASE WHEN k % 2 = 0 THEN 'page 2' ELSE 'pages 1–8' END || ' · rule' AS publisher,
       'low|1|No value matched the configured metadata rules.|Extracted text · pages 1–8 · not_found' AS citations FROM (SELECT *, o_orderkey AS k FROM orders)""",
    "dates_with_fallbacks": """
SELECT k AS doc_id, CASE WHEN k % 4 = 0 THEN '2011-05' WHEN k % 3 = 1 THEN (1990 + k % 20)::VARCHAR ELSE '2007' END AS value, CASE WHEN k % 4 = 0 OR k % 3 = 1 THEN 1 END AS page,
       CASE WHEN k % 4 = 0 THEN 'subject' WHEN k % 3 = 1 THEN 'copyright_year' ELSE 'file_name' END AS method, CASE WHEN k % 4 = 0 THEN 0.88 WHEN k % 3 = 1 THEN 0.82 ELSE 0.45 END::DOUBLE AS confidence
FROM (SELECT p_partkey AS k FROM part) WHERE k % 4 = 0 OR k % 3 = 1 OR k % 5 > 0""",
    "record_upserts": f"SELECT id, title, CASE WHEN record_key % 3 = 0 THEN 'Press' ELSE publisher END AS publisher FROM ({RECORDS}) UNION ALL SELECT 'n-' || n_nationkey, n_name, NULL FROM nation",
    "finished_records": f"""
SELECT id, CASE WHEN k % 4 = 0 THEN 'Found' ELSE title END AS title, publisher, CASE WHEN k % 2 = 0 THEN 'complete' ELSE state END AS job_state, CASE WHEN k % 2 = 0 THEN 8 ELSE 3 END AS job_step,
       CASE WHEN k % 2 = 0 THEN 'Ready for review' ELSE 'Reading' END AS job_message, CASE WHEN k % 2 = 0 THEN greatest(1, round_even(k / 7 * 1000, 0))::BIGINT ELSE 0 END AS job_ms FROM (SELECT *, record_key AS k FROM ({RECORDS}))""",
    "deleted_artifacts": "SELECT o_orderkey AS document_id, name FROM orders, (SELECT unnest(['source.pdf', 'publication.json', 'page-12.png', 'page_1.png', 'blocks.json']) AS name) WHERE o_orderkey % 2 = 1 OR name NOT IN ('publication.json', 'page-12.png')",
    "assembled_blocks": f"""
WITH t AS (SELECT l_orderkey AS doc_id, nth, l_partkey AS k, l_linenumber AS page, 't' || nth AS ref, CASE WHEN l_partkey % 7 = 0 THEN '' ELSE 'Words ' || l_partkey END AS text FROM ({_NTH})),
v AS (SELECT * FROM t WHERE nth <> 3 AND k % 5 <> 0),
m AS (SELECT doc_id, min_by(ref, nth) AS ref FROM (SELECT *, 80 + CASE WHEN length(text) BETWEEN 18 AND 120 THEN 100 ELSE 0 END + CASE WHEN len(string_split(text, ' ')) BETWEEN 3 AND 14 THEN 100 ELSE 0 END - CASE WHEN len(string_split(text, ' ')) <= 2 THEN 100 ELSE 0 END + least(length(text), 80) * 0.5 AS score FROM v WHERE k % 4 = 1 AND page <= 5 AND text <> '')
      s WHERE score = (SELECT max(80 - 100 + length(z.text) * 0.5) FROM v z WHERE z.doc_id = s.doc_id AND z.k % 4 = 1 AND z.page <= 5 AND z.text <> '') GROUP BY 1),
b AS (SELECT v.doc_id, v.ref AS block_id, CASE WHEN m.ref IS NOT NULL THEN 'title' WHEN k % 4 = 1 THEN 'section_header_3' WHEN k % 4 = 2 THEN 'footer' ELSE 'text' END AS label, text, nth / 10 AS confidence FROM v LEFT JOIN m ON m.doc_id = v.doc_id AND m.ref = v.ref WHERE k % 4 > 0 AND NOT (k % 4 = 2 AND text = '')
      UNION ALL SELECT doc_id, 'list', 'list', coalesce(string_agg(CASE WHEN text <> '' THEN CASE WHEN k % 8 = 0 THEN '1. ' ELSE '• ' END || text END, chr(10) ORDER BY nth), ''), min(nth) / 10 FROM v WHERE k % 4 = 0 GROUP BY 1)
SELECT * FROM b UNION ALL SELECT o_orderkey, '#/synthetic/document-title', 'title', 'the name', 1 FROM orders WHERE o_orderkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM b WHERE doc_id = o_orderkey AND label = 'title')""",
    "outline_in_blocks": f"""
WITH x AS ({BOX_SQL}), c AS (SELECT doc_id, page, count(*) AS n, count(*) FILTER (t < 30) AS above FROM x GROUP BY 1, 2),
s AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT doc_id, page, (before + above)::INT AS heading_at, before::INT AS first_at, n + 1 AS blocks FROM s""",
    "without_local_contents": f"""
WITH x AS (SELECT *, l_partkey % 4 AS g, ord * 1000 + t AS o FROM ({BOX_SQL})),
y AS (SELECT *, max_by(g, o) FILTER (g <> 1) OVER (PARTITION BY doc_id, page ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x)
SELECT doc_id, count(*) AS blocks FROM y WHERE g <> 2 AND NOT (g = 0 AND before IS NOT NULL AND before = 2) GROUP BY 1""",
    "heading_styles": f"""
WITH x AS ({BOX_SQL}), i AS (SELECT *, concat_ws('-', l_linenumber, l_partkey, t::INT) AS ref FROM x WHERE l_linenumber % 2 = 1), c AS (SELECT * FROM x WHERE l_linenumber % 2 = 0)
SELECT DISTINCT i.doc_id, i.ref, round_even(max(c.l_partkey % 40 / 3) * 2, 0) / 2 AS size FROM i JOIN c ON c.doc_id = i.doc_id AND c.page = i.page
WHERE greatest(0, least(i.r, c.r) - greatest(i.l, c.l)) * greatest(0, least(i.b, c.b) - greatest(i.t, c.t)) >= 0.16 * least((i.r - i.l) * (i.b - i.t), (c.r - c.l) * (c.b - c.t)) GROUP BY 1, 2, i.ord""",
    "list_item_order": """
WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 + 1 AS page, (l_linenumber * 1000000 + l_partkey) * 1000 + l_suppkey AS ord, l_partkey % 5 = 0 AS bare, l_partkey % 2 AS side, l_partkey % 2 * 300 + l_partkey % 7 AS l, l_suppkey % 50 AS t FROM lineitem)
SELECT DISTINCT doc_id, ord, (row_number() OVER (PARTITION BY doc_id ORDER BY page, bare, CASE WHEN NOT bare THEN side END, CASE WHEN NOT bare THEN t END, CASE WHEN NOT bare THEN l END, ord) - 1)::INT AS place FROM i""",
    "list_entry_variants": """
WITH p AS (SELECT p_partkey, p_partkey % 7 AS g, p_partkey % 13 = 0 AS bare, ['12.', '(3)', '(4.', 'iv)', '•', '·', 'no'][p_partkey % 7 + 1] AS m, p_name FROM part)
SELECT p_partkey, CASE WHEN bare THEN m WHEN g IN (2, 6) THEN m || ' ' || p_name ELSE p_name END AS text, CASE WHEN bare OR g IN (2, 6) THEN '' ELSE m END AS marker, CASE WHEN NOT bare THEN CASE g WHEN 0 THEN 12 WHEN 1 THEN 3 END END AS value,
       CASE WHEN bare THEN m WHEN g IN (5, 6) THEN m || ' ' || p_name ELSE p_name END AS shown_text, CASE WHEN bare OR g IN (5, 6) THEN '' ELSE m END AS shown_marker, CASE WHEN NOT bare THEN CASE g WHEN 0 THEN 12 WHEN 1 THEN 3 WHEN 2 THEN 4 END END AS shown_value FROM p""",
}
