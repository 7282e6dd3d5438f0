"""Whole pages of publications: nested blocks, readers of sections, an accordion of contents, cards and reading lists, in markup of our own.

sections(doc_id, section_id, position, title, is_chapter); headings(doc_id, section_id, ord, level, slug, text); notes(doc_id, section_id, number, note_id, text);
blocks(doc_id, section_id, block_id, parent_id, ord, type, level, slug, text, list_items, style, start, cells, caption, title, variant), parent_id naming the box
that a block stands in. All text is escaped before it meets markup.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.text import html_escape
from pageloom.operators.rendering import fragment, nested_list, tag
from pageloom.operators.sequential import in_groups, linked_footnotes

NO_NOTES = "map<string,string>"


@F.arrow_udf(T.StringType())
def _linked(texts, notes):
    return pa.array([linked_footnotes(t or "", dict(known or [])) for t, known in zip(texts.to_pylist(), notes.to_pylist(), strict=True)], pa.string())


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _linked_cells(rows, notes):
    made = [[[linked_footnotes(c["text"] or "", dict(known or [])) for c in row] for row in own or []] for own, known in zip(rows.to_pylist(), notes.to_pylist(), strict=True)]
    return pa.array(made, pa.list_(pa.list_(pa.string())))


def escaped(value: Column) -> Column:
    return html_escape(F.coalesce(value, F.lit("")))


def inline(text: Column, notes: Column) -> Column:
    """Escaped text with its footnotes linked; texts without a figure, or of sections without notes, never leave the JVM."""
    return F.when((F.size(notes) > 0) & F.coalesce(text, F.lit("")).rlike(r"\d"), _linked(text, notes)).otherwise(escaped(text))


def table_of_cells(cells: Column, html: Column, caption: Column, slug: Column) -> Column:
    """A table of struct(text, column_header, row_header, row_span, col_span) with the markup of each cell: the first row whose cells are all column headers is its head."""

    def cell(c: Column, inner: Column) -> Column:
        name = F.when(c["column_header"] | c["row_header"], "th").otherwise("td")
        scope = F.when(c["column_header"], ' scope="col"').when(c["row_header"], ' scope="row"').otherwise("")
        span = lambda side: F.when(F.coalesce(c[f"{side}_span"], F.lit(1)) > 1, F.concat(F.lit(f' {side}span="'), c[f"{side}_span"].cast("string"), F.lit('"'))).otherwise("")
        return F.concat(F.lit("<"), name, scope, span("row"), span("col"), F.lit(">"), inner, F.lit("</"), name, F.lit(">"))

    rows = F.zip_with(cells, html, lambda row, inner: F.struct(F.forall(row, lambda c: c["column_header"]) & (F.size(row) > 0), tag("tr", F.array_join(F.zip_with(row, inner, cell), ""))).cast("struct<heads:boolean,html:string>"))
    first = F.array_position(F.transform(rows, lambda r: r["heads"]), F.lit(True)).cast("int")
    head = F.when(first > 0, tag("thead", F.get(rows, first - 1)["html"])).otherwise("")
    body = F.array_join(F.transform(F.filter(rows, lambda r, k: k != first - 1), lambda r: r["html"]), "")
    named = F.trim(F.coalesce(caption, F.lit("")))
    return F.concat(F.lit('<table id="'), escaped(slug), F.lit('">'), F.when(named != "", tag("caption", escaped(named))).otherwise(""), head, tag("tbody", body), F.lit("</table>"))


def with_markup(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """blocks with `opens` and `closes`: the markup before and after what stands in them; only boxes have something in them."""
    known = notes.groupBy("doc_id", "section_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("number").cast("string"), "note_id"))).alias("notes"))
    met = blocks.join(known, ["doc_id", "section_id"], "left").withColumn("notes", F.coalesce("notes", F.create_map().cast(NO_NOTES)))
    lists = F.when(F.col("type") == "list", nested_list("list_items", "style", "start", "notes"))
    # held to be non-deterministic, so that it stays a column of its own and out of the lambdas that read it
    met = met.withColumn("cell_html", F.when(F.col("type") == "table", _linked_cells.asNondeterministic()("cells", "notes")))
    held = F.when(F.col("type") == "table", table_of_cells(F.col("cells"), F.col("cell_html"), F.col("caption"), F.col("slug")))
    plain = F.when(F.col("type") == "paragraph", F.when(F.trim(F.coalesce("text", F.lit(""))) != "", tag("p", inline(F.col("text"), F.col("notes")))).otherwise(""))
    met = met.withColumns({"items": F.lit(None).cast("array<string>"), "headers": F.lit(None).cast("array<string>"), "rows": F.lit(None).cast("array<array<string>>")})
    others = fragment(met)
    variant = F.coalesce(F.nullif(F.regexp_replace(F.lower(F.coalesce("variant", F.lit(""))), "[^a-z-]", ""), F.lit("")), F.lit("information"))
    box_id = escaped(F.coalesce("slug", "block_id"))
    opens = F.concat(F.lit('<section class="box box--'), variant, F.lit('" aria-labelledby="'), box_id, F.lit('-title"><h3 id="'), box_id, F.lit('-title">'), escaped(F.coalesce("title", F.lit("Box Section"))), F.lit("</h3>"))
    box = F.col("type") == "box_section"
    return met.withColumns({"opens": F.when(box, opens).otherwise(F.coalesce(lists, held, plain, others)), "closes": F.when(box, "</section>").otherwise("")}).drop("items", "headers", "rows")


def joined_up(rows: list[tuple]) -> list[tuple]:
    """(doc_id, section_id, html) of a section's blocks (doc_id, section_id, ord, block_id, parent_id, opens, closes) in order, each inside its parent, at any depth.

    A block whose parent isn't there stands by itself; blocks that stand in each other without end are left out.
    """
    known = {row[3] for row in rows}
    inside: dict[str | None, list[tuple]] = {}
    for row in rows:
        inside.setdefault(row[4] if row[4] in known else None, []).append(row)
    out, waiting = [], [(row, False) for row in reversed(inside.get(None, []))]
    while waiting:
        row, done = waiting.pop()
        out.append(row[6] if done else row[5])
        if not done:
            waiting.append((row, True))
            waiting += [(child, False) for child in reversed(inside.get(row[3], []))]
    return [(rows[0][0], rows[0][1], "".join(x for x in out if x))]


def section_bodies(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, section_id, body): the blocks of each section, boxes around what stands in them."""
    made = with_markup(blocks, notes).select("doc_id", "section_id", "ord", "block_id", "parent_id", "opens", "closes")
    kinds = [made.schema[c].dataType.simpleString() for c in ("doc_id", "section_id")]
    return in_groups(made, ["doc_id", "section_id"], ["ord", "block_id"], joined_up, f"doc_id {kinds[0]}, section_id {kinds[1]}, body string")


def nested_links(rows: list[tuple]) -> list[tuple]:
    """(doc_id, section_id, html) of links (doc_id, section_id, ord, level, slug, text) as lists in lists: a deeper link stands in the item before it.

    Every list and item that is opened is closed, whatever the order of levels.
    """
    out, held = [], []
    for _, _, _, level, slug, text in rows:
        while held and held[-1] > level:
            out.append("</li></ul>")
            held.pop()
        if held and held[-1] == level:
            out.append("</li>")
        else:
            out.append("<ul>")
            held.append(level)
        out.append(f'<li><a href="#{slug}">{text}</a>')
    return [(rows[0][0], rows[0][1], "".join(out) + "</li></ul>" * len(held))]


def reading_lists(headings: DataFrame) -> DataFrame:
    """(doc_id, section_id, links): the headings of each section as nested links."""
    made = headings.select("doc_id", "section_id", "ord", F.greatest(F.lit(2), F.least(F.lit(6), F.coalesce("level", F.lit(2)))).alias("level"), escaped(F.col("slug")).alias("slug"), escaped(F.col("text")).alias("text"))
    kinds = [made.schema[c].dataType.simpleString() for c in ("doc_id", "section_id")]
    return in_groups(made, ["doc_id", "section_id"], ["ord"], nested_links, f"doc_id {kinds[0]}, section_id {kinds[1]}, links string")


def in_order(df: DataFrame, order: str, html: str, name: str) -> DataFrame:
    """(doc_id, name): the pieces of each document joined in order."""
    return df.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, html))), lambda x: x[html]), "").alias(name))


def accordions(sections: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, contents): chapters as folds with links to the whole and to their major headings (levels 2 and less), other sections as plain links."""
    major = headings.where(F.coalesce("level", F.lit(2)) <= 2).groupBy("doc_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("ord", "slug", "text"))).alias("major"))
    link = lambda slug, text: F.concat(F.lit('<a href="#'), escaped(slug), F.lit('">'), escaped(text), F.lit("</a>"))
    reader = F.concat(F.lit("reader-"), F.col("section_id").cast("string"))
    links = F.array_join(F.transform(F.coalesce("major", F.array().cast("array<struct<ord:int,slug:string,text:string>>")), lambda h: tag("li", link(h["slug"], h["text"]))), "")
    fold = tag("details", F.concat(tag("summary", escaped(F.col("title"))), tag("ul", F.concat(tag("li", link(reader, F.lit("Read full section"))), links))), ' class="chapter"')
    met = sections.join(major, ["doc_id", "section_id"], "left").withColumn("html", F.when(F.col("is_chapter"), fold).otherwise(tag("div", link(reader, F.col("title")), ' class="section"')))
    return in_order(met, "position", "html", "contents")


def cards(snippets: DataFrame) -> DataFrame:
    """(doc_id, cards) of snippets(doc_id, ord, text), numbered from 01."""
    items = F.array_sort(F.collect_list(F.struct("ord", "text")))
    card = lambda x, k: tag("article", F.concat(tag("strong", F.lpad((k + 1).cast("string"), 2, "0")), tag("p", escaped(x["text"]))))
    return snippets.groupBy("doc_id").agg(tag("section", F.concat(tag("h2", F.lit("Key recommendations")), F.array_join(F.transform(items, card), "")), ' class="cards"').alias("cards"))


def readers(sections: DataFrame, bodies: DataFrame, links: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, readers): each section with its reading list, its blocks, its notes, and the sections before and after it."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("doc_id").orderBy("position")
    note = F.struct("number", F.concat(F.lit('<li id="'), escaped(F.col("note_id")), F.lit('">'), escaped(F.col("text")), F.lit("</li>")).alias("html"))
    kept = notes.groupBy("doc_id", "section_id").agg(F.transform(F.array_sort(F.collect_list(note)), lambda x: x["html"]).alias("noted"))
    met = sections.withColumns({"before": F.lag("title").over(order), "after": F.lead("title").over(order)})
    for more in (bodies, links, kept):
        met = met.join(more, ["doc_id", "section_id"], "left")
    footnotes = F.when(F.size("noted") > 0, tag("details", F.concat(tag("summary", F.concat(F.lit("References and footnotes ("), F.size("noted").cast("string"), F.lit(")"))), tag("ol", F.array_join("noted", ""))))).otherwise("")
    turn = lambda word, title, end: tag("span", F.concat(F.lit(f"{word}: "), escaped(F.coalesce(title, F.lit(end)))))
    html = F.concat(
        F.lit('<section class="reader" id="reader-'), F.col("section_id").cast("string"), F.lit('">'), tag("nav", F.concat(tag("h2", F.lit("In this section")), F.coalesce("links", F.lit("")))),
        tag("h1", escaped(F.col("title"))), F.coalesce("body", F.lit("")), footnotes, tag("nav", F.concat(turn("Previous", F.col("before"), "Beginning of document"), turn("Next", F.col("after"), "End of document"))), F.lit("</section>"),
    )
    return in_order(met.withColumn("html", html), "position", "html", "readers")


def report_card(documents: DataFrame) -> Column:
    """The card of documents(title, publisher, summary, published, pages, jurisdiction)."""
    fact = lambda name, value: tag("div", F.concat(tag("dt", F.lit(name)), tag("dd", value)))
    summary = F.coalesce(F.nullif(F.trim(F.coalesce("summary", F.lit(""))), F.lit("")), F.concat(F.lit("This publication presents the reviewed content of "), "title", F.lit(".")))
    facts = tag("dl", F.concat(fact("Published", escaped(F.col("published"))), fact("Length", F.concat(F.coalesce("pages", F.lit(0)).cast("string"), F.lit(" pages"))), fact("Jurisdiction", escaped(F.coalesce(F.nullif(F.trim(F.coalesce("jurisdiction", F.lit(""))), F.lit("")), F.lit("Not specified"))))))
    return tag("section", F.concat(tag("h1", escaped(F.col("title"))), tag("p", escaped(F.col("publisher"))), tag("p", escaped(summary)), facts), ' class="card"')


def publication_bodies(documents: DataFrame, sections: DataFrame, headings: DataFrame, blocks: DataFrame, notes: DataFrame, snippets: DataFrame) -> DataFrame:
    """(doc_id, title, body): card, recommendations, contents, citation and readers of documents(doc_id, title, publisher, summary, published, pages, jurisdiction, citation)."""
    met = documents
    for more in (cards(snippets), accordions(sections, headings), readers(sections, section_bodies(blocks, notes), reading_lists(headings), notes)):
        met = met.join(more, "doc_id", "left")
    said = F.coalesce(F.nullif(F.trim(F.coalesce("citation", F.lit(""))), F.lit("")), F.concat_ws(", ", "publisher", "title"))
    cite = tag("section", F.concat(tag("h2", F.lit("Cite this report")), tag("blockquote", escaped(said))), ' class="citation"')
    contents = tag("section", F.concat(tag("h2", F.lit("Table of contents")), F.coalesce("contents", F.lit(""))), ' class="contents"')
    return met.select("doc_id", "title", F.concat(report_card(met), F.coalesce("cards", F.lit("")), contents, cite, F.coalesce("readers", F.lit(""))).alias("body"))
