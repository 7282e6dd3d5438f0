"""Compiling blocks into a publication: sections, levels, slugs, lists, order, summary, statistics, JSON-LD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.functions import dates
from pageloom.functions.text import BULLET, ORDERED, citation_type, evidence_key, section_key, slug, squeezed, stripped

#: Titles of sections that readers don't get.
FRONT = ("front matter", "contents", "table of contents")
TEXT_LABELS = ("title", "section_header_1", "section_header_2", "section_header_3", "section_header_4", "section_header_5", "text", "list", "list_item", "footnote", "caption", "formula")


def sections(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, ord, page, level, text) with their section: 0 before the first H1, then counted by H1s.

    An H1 with the key of the H1 before it goes on with that section. Rows of one place have one section, after all the starts there.
    """
    h1 = blocks.where(F.col("level") == 1).withColumn("key", section_key(F.col("text")))
    order = Window.partitionBy("doc_id").orderBy("ord")
    starts = h1.withColumn("starts", ~F.col("key").eqNullSafe(F.lag("key").over(order))).select("doc_id", "ord", "starts")
    met = blocks.join(starts, ["doc_id", "ord"], "left")
    so_far = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return met.withColumn("section", F.sum(F.coalesce(F.col("starts"), F.lit(False)).cast("int")).over(so_far).cast("bigint")).withColumn("starts", F.coalesce("starts", F.lit(False)))


def section_table(sectioned: DataFrame) -> DataFrame:
    """One row a section: title and first page."""
    heads = F.when(F.col("starts"), F.struct("ord", "text"))
    return sectioned.groupBy("doc_id", "section").agg(F.coalesce(F.min(heads)["text"], F.lit("Front matter")).alias("title"), F.min("page").alias("page"), F.count("*").alias("blocks"))


def heading_close_up(headings: DataFrame, keys: list[str], order: str, level: str, first: int = 1) -> DataFrame:
    """The closed-up level of each heading, one row each: levels 2 to 5, none more than one deeper than the level before.

    The n-th level less n is the least of all levels so far, each less its own place, and of the first level; so a running minimum closes all gaps.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = headings.select(*keys, order, F.greatest(F.lit(2), F.least(F.lit(5), F.col(level).cast("int"))).alias("level"), F.row_number().over(w).alias("n"))
    least = F.min(F.col("level") - F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(*keys, order, (F.least(least, F.lit(first)) + F.col("n")).alias("level"))


def unique_slugs(titles: DataFrame, keys: list[str], order: str, title: str) -> DataFrame:
    """titles with a slug; the n-th of equal ones of a document gets the suffix -n."""
    base = titles.withColumn("base", slug(F.col(title)))
    n = F.row_number().over(Window.partitionBy(*keys, "base").orderBy(order))
    return base.withColumn("slug", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n.cast("string")))).drop("base")


def list_runs(items: DataFrame, keys: list[str], order: str, style: str, nested: Column | None = None) -> DataFrame:
    """items with the number of their run: a new one where the style of top-level items changes."""
    w = Window.partitionBy(*keys).orderBy(order)
    top = F.lit(True) if nested is None else ~nested
    own = F.when(top, F.col(style))
    before = F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    breaks = F.coalesce(top & ~own.eqNullSafe(before), F.lit(False)).cast("int")
    return items.withColumn("run", F.sum(breaks).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))


def published_lists(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The blocks that items(keys, order, text, marker, enumerated, level) of lists make: one row each, type `list` or `paragraph`.

    An item without marker that begins with a number such as 1.2 is a paragraph with that number, and ends the list before it. A top-level item of the other
    style than the list's first ends it, too; nested ones don't. A list has its style, the number it starts with, and its items in order.
    """
    number = F.regexp_extract("text", r"(?s)^(\d+(?:\.\d+)+)\s+.+$", 1)
    bare = F.trim(F.coalesce("marker", F.lit(""))) == ""
    rows = items.withColumns({"_par": bare & (number != ""), "_style": F.when(F.coalesce("enumerated", F.lit(False)), "ordered").otherwise("unordered"), "_level": F.greatest(F.lit(0), F.coalesce("level", F.lit(0)))})
    w = Window.partitionBy(*keys).orderBy(order)
    so_far = lambda spec: spec.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_part", F.sum(F.col("_par").cast("int")).over(so_far(w))).withColumn("_first", F.coalesce(F.lag("_par").over(w), F.lit(True)))
    inner = Window.partitionBy(*keys, "_part").orderBy(order)
    anchor = F.when(~F.col("_par") & ((F.col("_level") == 0) | F.col("_first")), F.col("_style"))
    before = F.last(anchor, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, -1))
    breaks = ~F.col("_par") & (F.col("_level") == 0) & before.isNotNull() & (before != F.col("_style"))
    rows = rows.withColumn("_run", F.sum((F.coalesce(breaks, F.lit(False)) | F.col("_par") | F.col("_first")).cast("int")).over(so_far(w)))
    value = F.nullif(F.regexp_extract("marker", r"^\(?(\d+)[.)]$", 1), F.lit("")).cast("int")
    entry = F.when(F.col("text") != "", F.struct(F.col(order).alias("ord"), "text", F.coalesce("marker", F.lit("")).alias("marker"), F.col("_level").alias("level"), F.coalesce("enumerated", F.lit(False)).alias("ordered"), value.alias("value")))
    start = F.when(F.col("_style") == "ordered", F.struct(F.col(order).alias("o"), F.coalesce(F.nullif(value, F.lit(0)), F.lit(1)).alias("start")))
    each = rows.groupBy(*keys, "_run").agg(
        F.min(order).alias(order),
        F.bool_or("_par").alias("_par"),
        F.min_by("text", order).alias("_text"),
        F.min_by("_style", order).alias("style"),
        F.min(start)["start"].alias("start"),
        F.array_sort(F.collect_list(entry)).alias("items"),
    )
    kept = each.where(F.col("_par") | (F.size("items") > 0))
    paragraph = lambda value: F.when(F.col("_par"), value)
    listed = lambda value: F.when(~F.col("_par"), value)
    return kept.select(*keys, order, F.when(F.col("_par"), "paragraph").otherwise("list").alias("type"), paragraph(F.regexp_extract("_text", r"(?s)^\d+(?:\.\d+)+\s+(.+)$", 1)).alias("text"), paragraph(F.regexp_extract("_text", r"(?s)^(\d+(?:\.\d+)+)\s+.+$", 1)).alias("number"), listed(F.col("style")).alias("style"), listed(F.col("start")).alias("start"), listed(F.col("items")).alias("items"))


def interpolated_order(rows: DataFrame) -> DataFrame:
    """rows(doc_id, ord, page, seq) with a sort position: seq, or one estimated from the pages of rows that have one.

    Before the first of those it is seq - 1 less a trace, after the last seq + 1 and a trace, and between two in proportion to the page;
    where seq doesn't grow, just after the earlier one.
    """
    anchors = rows.where(F.col("seq").isNotNull()).select("doc_id", "page", F.col("seq").cast("double").alias("s"), F.col("ord").alias("o"))
    every = rows.select("doc_id", "ord", "page", "seq").withColumn("o", F.lit(None).cast("bigint")).withColumn("s", F.lit(None).cast("double")).unionByName(
        anchors.select("doc_id", F.lit(None).cast("bigint").alias("ord"), "page", F.lit(None).cast("bigint").alias("seq"), F.col("o").cast("bigint").alias("o"), "s")
    )
    anchor = F.when(F.col("s").isNotNull(), F.struct("page", "s"))
    is_row = F.col("ord").isNotNull().cast("int")
    w = Window.partitionBy("doc_id").orderBy("page", is_row, "s", "o", "ord")
    before = F.last(anchor, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(anchor, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    met = every.withColumn("b", before).withColumn("a", after).where("ord is not null")
    b, a, page = F.col("b"), F.col("a"), F.col("page")
    share = (page - b["page"]) / F.greatest(F.lit(1), a["page"] - b["page"])
    between = F.when(a["s"] > b["s"], b["s"] + share * (a["s"] - b["s"])).otherwise(b["s"] + 0.5 + share / 100)
    estimate = (
        F.when(F.col("seq").isNotNull(), F.col("seq").cast("double"))
        .when(b.isNull() & a.isNull(), F.col("ord").cast("double"))
        .when(b.isNull(), a["s"] - 1 - (a["page"] - page) / 100000)
        .when(a.isNull(), b["s"] + 1 + (page - b["page"]) / 100000)
        .otherwise(between)
    )
    return met.select("doc_id", "ord", "page", "seq", estimate.alias("position"))


def for_readers(section_rows: DataFrame) -> DataFrame:
    """Sections without front matter and contents."""
    return section_rows.where(~F.lower(F.trim("title")).isin(*FRONT))


def reader_sections(section_rows: DataFrame) -> DataFrame:
    """Sections for readers; a document that has none gets its first section with blocks, as `Document`."""
    plain = ~F.lower(F.trim("title")).isin(*FRONT)
    whole = Window.partitionBy("doc_id")
    rows = section_rows.withColumns({"_plain": plain, "_any": F.max(plain).over(whole), "_first": F.min(F.when(F.col("blocks") > 0, F.col("section"))).over(whole)})
    kept = rows.where(F.col("_plain") | (~F.col("_any") & (F.col("section") == F.col("_first"))))
    return kept.withColumn("title", F.when(F.col("_plain"), F.col("title")).otherwise("Document")).drop("_plain", "_any", "_first")


def own_titles(sectioned: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks without a section's first heading where it says what the section's title says, and titles(doc_id, section, title) with a display title.

    The heading of such a section is its display title; front matter keeps its own. Of blocks in one place only one is the heading.
    """
    inner = F.coalesce(F.col("level").between(2, 5) & (F.col("section") > 0), F.lit(False))
    nth = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy((~inner).cast("int"), "ord", "text"))
    marked = sectioned.withColumn("_heads", inner & (nth == 1))
    first = marked.where("_heads").select("doc_id", "section", F.col("text").alias("said"))
    said = titles.join(first, ["doc_id", "section"]).where(section_key(F.col("said")) == section_key(F.col("title"))).select("doc_id", "section", "said")
    shown = titles.join(said, ["doc_id", "section"], "left").withColumn("display_title", F.coalesce(F.nullif("said", F.lit("")), "title")).drop("said")
    gone = said.select("doc_id", "section", F.lit(True).alias("_heads"))
    return marked.join(gone, ["doc_id", "section", "_heads"], "left_anti").select(*sectioned.columns), shown


def major_headings(headings: DataFrame) -> DataFrame:
    """The second-level headings(doc_id, ord, page, level, seq) of documents, numbered by their place in the contents, then by page."""
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("seq", F.lit(1_000_000)), "page", "ord")
    return headings.where(F.coalesce("level", F.lit(2)) == 2).withColumn("place", F.row_number().over(order))


def neighbours(section_rows: DataFrame, order: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(order)
    return section_rows.withColumns({"previous": F.lag("title").over(w), "next": F.lead("title").over(w)})


def statistics(blocks: DataFrame) -> DataFrame:
    """Counts of a publication's parts, without removed blocks."""
    label = F.col("label")
    return blocks.where(~F.coalesce("removed", F.lit(False))).groupBy("doc_id").agg(
        F.count_distinct("page").alias("pages"),
        F.count_if(label.isin(*TEXT_LABELS)).alias("text_items"),
        F.count_if(label.isin("table", "document_index")).alias("tables"),
        F.count_if(label == "picture").alias("pictures"),
        F.count_if(label == "footnote").alias("footnotes"),
    )


def sentences_of(text: Column) -> Column:
    return F.split(squeezed(text), r"(?<=[.!?])\s+")


def summary(values: Column, limit: int) -> Column:
    """Sentences of 35 characters and more, each once, while they fit; the first that doesn't ends its paragraph.

    Paragraphs are taken until the summary fills 65 hundredths of the limit. Without such sentences the text itself is cut
    after a sentence in its second half, else after a whole word.
    """
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.array().cast("array<string>").alias("seen"))

    def sentence(state: Column, s: Column) -> Column:
        key = F.lower(s)
        skip = state["stop"] | (F.length(s) < 35) | F.array_contains(state["seen"], key)
        more = F.concat(state["taken"], F.array(s))
        fits = F.length(F.array_join(more, " ")) <= limit
        return F.struct(
            F.when(~skip & fits, more).otherwise(state["taken"]).alias("taken"),
            F.when(skip, state["seen"]).otherwise(F.concat(state["seen"], F.array(key))).alias("seen"),
            (state["stop"] | (~skip & ~fits)).alias("stop"),
        )

    def paragraph(state: Column, text: Column) -> Column:
        full = F.length(F.array_join(state["taken"], " ")) >= limit * 0.65
        begin = F.struct(state["taken"].alias("taken"), state["seen"].alias("seen"), (full & (F.size(state["taken"]) > 0)).alias("stop"))
        return F.aggregate(sentences_of(text), begin, sentence, lambda s: F.struct(s["taken"].alias("taken"), s["seen"].alias("seen")))

    taken = F.aggregate(values, start, paragraph, lambda s: F.array_join(s["taken"], " "))
    whole = squeezed(F.array_join(values, " "))
    head = F.substring(whole, 1, limit)
    at = F.length(F.regexp_extract(head, r"^(.*[.?!]) ", 1))
    word = F.regexp_extract(F.substring(whole, 1, limit - 1), r"^(.*) ", 1)
    cut = F.when(F.length(whole) <= limit, whole).when(at > limit // 2, F.substring(whole, F.lit(1), at)).otherwise(F.concat(F.rtrim(F.when(word == "", F.substring(whole, 1, limit - 2)).otherwise(word)), F.lit("…")))
    return F.when(taken != "", taken).otherwise(cut)


def snippets(paragraphs: DataFrame, keys: list[str], order: str, text: str, n: int = 3, least: int = 24) -> DataFrame:
    """The first n different paragraphs of enough length."""
    plain = squeezed(F.col(text))
    first = paragraphs.withColumn("snippet", plain).where(F.length("snippet") >= least).groupBy(*keys, "snippet").agg(F.min(order).alias("at"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("at", "snippet")))
    return ranked.where(F.col("rank") <= n).select(*keys, "rank", "snippet")


#: Headings under which a summary is looked for, in order (fixed values).
SUMMARIES = ("executive summary", "summary", "scope of report", "scope of the report", "scope of this report", "overview", "introduction")


def summary_heading(text: Column) -> Column:
    """A heading without its number, in lower case, marks as blanks."""
    bare = F.regexp_replace(text, r"(?i)^\s*(?:(?:chapter|section)\s+)?(?:\d+(?:\.\d+)*|[A-Z])(?:[.):\-–—]|\s)+", "")
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))


def summary_sources(blocks: DataFrame) -> DataFrame:
    """(doc_id, values, source) that a summary is made of: blocks(doc_id, ord, label, text, items).

    source is `heading`: texts and list items of 45 characters and more under the first of the headings above that has any, up to the next
    heading of its level; else `start`: the first three texts of 80 characters; else `none`, without values.
    """
    level = F.regexp_extract("label", "^section_header_([1-5])$", 1).try_cast("int")
    rows = blocks.withColumn("level", level).withColumn("t", stripped(F.col("text")))
    rank = F.array_position(F.array(*[F.lit(x) for x in SUMMARIES]), summary_heading(F.col("t")))
    heads = rows.where("level is not null").withColumn("rank", rank).where("rank > 0").select("doc_id", F.col("ord").alias("from_ord"), "rank", F.col("level").alias("own"))
    met = heads.join(rows.select("doc_id", "ord", "label", "level", "t", "items"), "doc_id").where(F.col("ord") > F.col("from_ord"))
    ends = Window.partitionBy("doc_id", "from_ord").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    inside = met.withColumn("ended", F.coalesce(F.max(F.col("level") <= F.col("own")).over(ends), F.lit(False))).where(~F.col("ended") & ~F.col("label").isin("header", "footer", "title", "document_index"))
    listed = F.transform(F.coalesce("items", F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(x, r"^\d+(?:\.\d+)+\s+", "")))
    found = F.filter(F.concat(F.when(F.col("label") == "text", F.array("t")).otherwise(F.array().cast("array<string>")), listed), lambda x: F.length(x) >= 45)
    each = inside.withColumn("found", found).where(F.size("found") > 0).groupBy("doc_id", "rank", "from_ord").agg(F.array_sort(F.collect_list(F.struct("ord", "found"))).alias("f"))
    under = each.groupBy("doc_id").agg(F.min_by("f", F.struct("rank", "from_ord")).alias("f")).select("doc_id", F.flatten(F.transform("f", lambda x: x["found"])).alias("under"))
    long = rows.where((F.col("label") == "text") & (F.length("t") >= 80)).withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where("n <= 3")
    start = long.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]).alias("start"))
    out = blocks.select("doc_id").distinct().join(under, "doc_id", "left").join(start, "doc_id", "left")
    source = F.when(F.col("under").isNotNull(), "heading").when(F.col("start").isNotNull(), "start").otherwise("none")
    return out.select("doc_id", F.coalesce("under", "start").alias("values"), source.alias("source"))


def publication_summary(blocks: DataFrame, names: DataFrame, limit: int = 600) -> DataFrame:
    """(doc_id, summary): of the sources above, or a fixed sentence with the document's name(doc_id, name)."""
    met = summary_sources(blocks).join(names, "doc_id", "left")
    fixed = F.concat(F.lit("This publication presents the reviewed content of "), F.coalesce("name", F.lit("Document")), F.lit("."))
    return met.select("doc_id", F.when(F.col("source") == "none", fixed).otherwise(summary(F.coalesce("values", F.array(F.lit(""))), limit)).alias("summary"))


def publication_cells(table: Column) -> Column:
    """The rows of a published table as cells: struct(text, row_span, col_span, column_header, row_header, start_column); headers are the first row."""

    def cells(row: Column, heads: bool) -> Column:
        return F.transform(row, lambda t, k: F.struct(F.coalesce(t, F.lit("")).alias("text"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit(heads).alias("column_header"), F.lit(False).alias("row_header"), k.alias("start_column")))

    body = F.transform(table["rows"], lambda r: cells(r, False))
    return F.when(F.size(table["headers"]) > 0, F.concat(F.array(cells(table["headers"], True)), body)).otherwise(body)


#: What the child of a box becomes by its label (fixed values); headings and paragraphs are handled apart.
BOXED = {"list": "list", "list_item": "list", "table": "table", "picture": "figure", "footnote": "footnote", "formula": "formula", "caption": "caption", "form": "group"}


def boxed_content(text: Column, page: Column, children: Column) -> Column:
    """The contents of a box: struct(type, text, level, number, page) for each child(label, text, page) in order.

    A box without children is a list if it has several lines and one bears a marker, else a paragraph a block of lines. A paragraph
    gives up the number it begins with; children without text, that are no table, figure or list, vanish.
    """
    part = lambda kind, t, p, level=None, number=None: F.struct(kind.alias("type"), t.alias("text"), (F.lit(None).cast("int") if level is None else level).alias("level"), (F.lit(None).cast("string") if number is None else number).alias("number"), p.cast("int").alias("page"))
    own = F.coalesce(text, F.lit(""))
    lines = F.filter(F.transform(F.split(own, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    is_list = (F.size(lines) > 1) & F.exists(lines, lambda x: x.rlike(ORDERED) | x.rlike(BULLET))
    paragraphs = F.transform(F.filter(F.transform(F.split(own, r"\n\s*\n"), stripped), lambda x: x != ""), lambda x: part(F.lit("paragraph"), x, page))
    alone = F.when(is_list, F.array(part(F.lit("list"), own, page))).otherwise(paragraphs)

    def child(c: Column) -> Column:
        label, t, p = F.coalesce(c["label"], F.lit("text")), stripped(c["text"]), F.coalesce(c["page"], page)
        kind = F.lit("paragraph")
        for name, becomes in BOXED.items():
            kind = F.when(label == name, becomes).otherwise(kind)
        kind = F.when(label.startswith("section_header_"), "heading").otherwise(kind)
        level = F.when(kind == "heading", F.least(F.lit(5), F.greatest(F.lit(1), F.regexp_extract(label, r"(\d+)$", 1).try_cast("int"))))
        number = F.when(kind == "paragraph", F.nullif(F.regexp_extract(t, r"(?s)^(\d+(?:\.\d+)+)\s+.+$", 1), F.lit("")))
        shown = F.when(number.isNotNull(), F.regexp_extract(t, r"(?s)^\d+(?:\.\d+)+\s+(.+)$", 1)).when((kind == "figure") & (t == ""), "Figure").otherwise(t)
        return F.when((kind != "paragraph") | (t != ""), part(kind, shown, p, level, number))

    return F.when(F.size(F.coalesce(children, F.array().cast(CHILDREN))) > 0, F.filter(F.transform(children, child), lambda x: x.isNotNull())).otherwise(alone)


CHILDREN = "array<struct<label:string,text:string,page:int>>"


def figures_captioned(blocks: DataFrame) -> DataFrame:
    """(doc_id, captioned): whether all figures, those in boxes among them, have a caption; so it is where there are none.

    blocks(doc_id, type, caption, children array of struct(type, caption)).
    """
    said = lambda kind, caption: (kind != "figure") | (F.trim(F.coalesce(caption, F.lit(""))) != "")
    inner = F.forall(F.coalesce("children", F.array().cast("array<struct<type:string,caption:string>>")), lambda c: said(c["type"], c["caption"]))
    return blocks.groupBy("doc_id").agg(F.coalesce(F.bool_and(said(F.col("type"), F.col("caption")) & inner), F.lit(True)).alias("captioned"))


def validation(headings: DataFrame) -> DataFrame:
    """For each document: headings that skip a level after the heading before."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    skipped = F.col("level") > F.coalesce(F.lag("level").over(w), F.col("level")) + 1
    return headings.withColumn("skips", skipped).groupBy("doc_id").agg(F.count_if("skips").alias("skipped_levels"), F.count("*").alias("headings"))


def full_validation(blocks: DataFrame, metadata: DataFrame, json_ld: DataFrame) -> DataFrame:
    """The six checks of a publication and what each has counted.

    blocks(doc_id, section, ord, type, level, headed, caption): a section's title counts as a heading of level 1; metadata(doc_id, title,
    publisher, published_date); json_ld(doc_id, json), a graph with a named Report node in the schema.org context or such a node alone.
    """
    w = Window.partitionBy("doc_id", "section").orderBy("ord")
    heads = blocks.where(F.col("type") == "heading").withColumn("skips", F.col("level") > F.coalesce(F.lag("level").over(w), F.lit(1)) + 1)
    skips = heads.groupBy("doc_id").agg(F.count_if("skips").alias("skipped_levels"))
    kind = F.col("type")
    each = blocks.groupBy("doc_id").agg(
        F.count_distinct("section").alias("sections"),
        F.count("*").alias("blocks"),
        F.count_if((kind == "table") & ~F.coalesce("headed", F.lit(False))).alias("headerless_tables"),
        F.count_if((kind == "figure") & (F.trim(F.coalesce("caption", F.lit(""))) == "")).alias("bare_figures"),
    )
    said = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    complete = metadata.select("doc_id", (said("title") & said("publisher") & said("published_date")).alias("metadata_complete"))
    nodes = F.from_json("json", "struct<`@context`:string,`@type`:string,name:string,`@graph`:array<struct<`@type`:string,name:string>>>")
    alone = F.array(F.struct(F.col("n.@type").alias("@type"), F.col("n.name").alias("name")))
    report = F.get(F.filter(F.coalesce(F.col("n.@graph"), alone), lambda x: F.col("n.@graph").isNull() | (x["@type"] == "Report")), F.lit(0))
    valid = (F.col("n.@context") == "https://schema.org") & (F.coalesce(report["@type"], F.lit("")) != "") & (F.coalesce(report["name"], F.lit("")) != "")
    linked = json_ld.withColumn("n", nodes).select("doc_id", F.coalesce(valid, F.lit(False)).alias("json_ld_valid"))
    met = metadata.select("doc_id").join(each, "doc_id", "left").join(skips, "doc_id", "left").join(complete, "doc_id").join(linked, "doc_id", "left")
    counts = ("sections", "blocks", "skipped_levels", "headerless_tables", "bare_figures")
    met = met.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}).withColumn("json_ld_valid", F.coalesce("json_ld_valid", F.lit(False)))
    passed = (F.col("blocks") > 0) & (F.col("skipped_levels") == 0) & (F.col("headerless_tables") == 0) & (F.col("bare_figures") == 0) & F.col("json_ld_valid") & F.col("metadata_complete")
    return met.select("doc_id", *counts, "json_ld_valid", "metadata_complete", passed.alias("passed"))


def pruned(struct: Column, fields: list[str]) -> Column:
    """A struct with null instead of empty strings, which to_json then leaves out."""
    return F.struct(*[F.nullif(struct[f], F.lit("")).alias(f) for f in fields])


def json_ld(doc_id: Column, title: Column, publisher: Column, date: Column, chapters: Column) -> Column:
    """The report node of a publication: chapters is an array of titles; what is unknown is left out."""
    parts = F.transform(chapters, lambda t, k: F.struct(F.lit("Chapter").alias("@type"), t.alias("name"), (k + 1).alias("position")))
    org = F.when(F.coalesce(publisher, F.lit("")) != "", F.struct(F.lit("Organization").alias("@type"), publisher.alias("name")))
    node = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("Report").alias("@type"),
        F.concat(F.lit("#"), doc_id.cast("string")).alias("@id"),
        F.nullif(title, F.lit("")).alias("name"),
        org.alias("publisher"),
        F.nullif(date, F.lit("")).alias("datePublished"),
        F.when(F.size(parts) > 0, parts).alias("hasPart"),
    )
    return F.to_json(node)




#: The parts of citations that identify a publication (fixed formats).
ISBN = r"(?i)\bISBNs?\b[:\s]*([0-9][0-9\- ]{7,20}[0-9Xx])"
ISSN = r"(?i)\bISSN\b[:\s]*([0-9]{4}-?[0-9]{3}[0-9Xx])"
SERIES = r"(?i)^Series:\s*(.+)$"
#: What a page says of its own accessibility (fixed texts).
ALWAYS = ("structuralNavigation", "tableOfContents", "readingOrder")
HAZARDS = ("noFlashingHazard", "noMotionSimulationHazard", "noSoundHazard")
CAPTIONED = "This HTML edition provides structural navigation, a table of contents, a defined reading order and alternative text for figures."
UNCAPTIONED = "This HTML edition provides structural navigation, a table of contents and a defined reading order. Some figures may not include source-supplied alternative text."


def split_values(value: Column) -> Column:
    """The parts of a value at semicolons, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def identifiers(values: Column) -> Column:
    """struct(kind, value, number) of each citation: isbn, issn, series (with its report number) or text."""

    def one(v: Column) -> Column:
        isbn, issn, series = (F.regexp_extract(v, p, 1) for p in (ISBN, ISSN, SERIES))
        named = F.regexp_extract(F.trim(series), r"^(.+?)[\s,]+(?:no\.?\s*)?(\d+)$", 1)
        number = F.regexp_extract(F.trim(series), r"^(.+?)[\s,]+(?:no\.?\s*)?(\d+)$", 2)
        kind = F.when(isbn != "", "isbn").when(issn != "", "issn").when(series != "", "series").otherwise("text")
        value = F.when(isbn != "", F.trim(isbn)).when(issn != "", F.trim(issn)).when(series != "", F.coalesce(F.nullif(F.trim(named), F.lit("")), F.trim(series))).otherwise(v)
        return F.struct(kind.alias("kind"), value.alias("value"), F.when(kind == "series", F.nullif(number, F.lit(""))).alias("number"))

    return F.transform(values, one)


def accessibility(captioned: Column) -> dict[str, Column]:
    """Fields that claim no more than a page with or without captions for all its figures can keep."""
    features = F.array(*[F.lit(x) for x in ALWAYS])
    listed = F.array(F.struct(F.lit("ItemList").alias("@type"), F.array(F.lit("textual")).alias("itemListElement")))
    return {
        "accessMode": F.array(F.lit("textual"), F.lit("visual")),
        "accessModeSufficient": F.when(captioned, listed),
        "accessibilityFeature": F.when(captioned, F.concat(features, F.array(F.lit("alternativeText")))).otherwise(features),
        "accessibilityHazard": F.array(*[F.lit(x) for x in HAZARDS]),
        "accessibilitySummary": F.when(captioned, CAPTIONED).otherwise(UNCAPTIONED),
    }


def json_ld_graph(documents: DataFrame, site_url: str = "", site_name: str = "", page_url: str = "", api_url: str = "", license_url: str = "", holder: str = "") -> DataFrame:
    """(doc_id, json): the linked graph of a document's report, page, cover, organisations and, on a site, the site and its path.

    documents(doc_id text, title, description, publisher, jurisdiction, authors, citations, date, generated_at, captioned, sections array of
    struct(id, title)); lists are texts with semicolons. page_url may have {slug} and {id}. Nodes are linked by @id; what is unknown is
    left out. A copyright holder that is one of the publishers is that node, and else a node of its own. The site is owned by the first publisher only where
    it bears its name.
    """
    none = lambda c: F.nullif(c, F.lit(""))
    ref = lambda i: F.struct(i.alias("@id"))
    some = lambda a: F.when(F.size(a) > 0, a)
    text = lambda value: F.lit(value) if value else F.lit(None).cast("string")
    doc, title = F.col("doc_id"), F.trim(F.coalesce("title", F.lit("")))
    d = documents.withColumns({"pubs": split_values(F.col("publisher")), "places": split_values(F.col("jurisdiction")), "people": split_values(F.col("authors")), "ids": identifiers(split_values(F.col("citations")))})
    root = F.concat(F.lit(f"{api_url.rstrip('/')}/api/documents/"), doc)
    page = F.replace(F.replace(F.lit(page_url), F.lit("{slug}"), slug(title, "document")), F.lit("{id}"), doc) if page_url else F.lit(None).cast("string")
    at = lambda mark, plain: F.concat(page, F.lit(f"#{mark}")) if page_url else F.concat(F.lit(f"#{plain}-"), doc)
    page_id = page if page_url else F.concat(F.lit("#webpage-"), doc)
    crumbs, image, report_id = at("breadcrumb", "breadcrumb"), at("primaryimage", "primaryimage"), F.concat(F.lit("urn:uuid:"), doc)
    owner = F.lit(bool(site_url and site_name)) & (F.lower(F.trim(F.coalesce(F.get("pubs", F.lit(0)), F.lit("")))) == site_name.strip().lower())
    org_id = lambda k: F.when(owner & (k == 0), f"{site_url}/#organization").otherwise(F.concat(F.lit("#organization-"), doc, F.when(k == 0, "").otherwise(F.concat(F.lit("-"), (k + 1).cast("string")))))
    orgs = F.transform("pubs", lambda v, k: F.struct(F.lit("Organization").alias("@type"), org_id(k).alias("@id"), v.alias("name"), F.when(owner & (k == 0), f"{site_url}/").alias("url")))
    own = F.get(F.filter(orgs, lambda o: F.lower(o["name"]) == holder.strip().lower()), F.lit(0))
    holder_id = F.coalesce(own["@id"], F.concat(F.lit("#copyright-holder-"), doc))
    extra = F.struct(F.lit("Organization").alias("@type"), holder_id.alias("@id"), F.lit(holder).alias("name"), F.lit(None).cast("string").alias("url"))
    nodes = F.concat(orgs, F.when(F.lit(bool(holder)) & own.isNull(), F.array(extra)).otherwise(F.array().cast("array<struct<`@type`:string,`@id`:string,name:string,url:string>>")))
    kinds = lambda *k: F.filter("ids", lambda x: x["kind"].isin(*k))
    numbered = F.transform(kinds("isbn", "issn"), lambda x: F.struct(F.lit("PropertyValue").alias("@type"), F.upper(x["kind"]).alias("propertyID"), x["value"].alias("value")))
    series = F.try_element_at(kinds("series"), F.lit(-1))
    bare = lambda v: F.regexp_extract(F.to_json(F.array(v)), r"(?s)^\[(.*)\]$", 1)
    typed = lambda v: F.to_json(F.struct(citation_type(v).alias("@type"), v.alias("name")))
    cited = F.array_join(F.transform(kinds("text"), lambda x: F.when(citation_type(x["value"]) == "text", bare(x["value"])).otherwise(typed(x["value"]))), ",")
    language = F.when(F.exists("places", lambda p: F.contains(F.lower(p), F.lit("australia"))), "en-AU").otherwise("en")
    named = lambda kind, values: some(F.transform(values, lambda v: F.struct(F.lit(kind).alias("@type"), v.alias("name"))))
    media = lambda kind, url: F.struct(F.lit("MediaObject").alias("@type"), F.lit(kind).alias("encodingFormat"), url.alias("contentUrl"))
    parts = F.transform("sections", lambda s, k: F.struct(F.lit("Chapter").alias("@type"), F.concat(report_id, F.lit("#"), s["id"]).alias("@id"), ref(report_id).alias("isPartOf"), s["title"].alias("name"), (k + 1).alias("position"), (F.concat(page, F.lit("#"), s["id"]) if page_url else F.lit(None).cast("string")).alias("url")))
    node = lambda **fields: F.to_json(F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(("@" + k[1:]) if k.startswith("_") else k) for k, v in fields.items()]))
    report = node(
        _type="Report", _id=report_id, name=none(title), description=none(F.trim(F.coalesce("description", F.lit("")))), inLanguage=language,
        author=named("Person", F.col("people")), publisher=some(F.transform(orgs, lambda o: ref(o["@id"]))), datePublished=F.coalesce(dates.iso(F.col("date")), none(F.trim(F.coalesce("date", F.lit(""))))),
        license=text(license_url), copyrightHolder=F.when(F.lit(bool(holder)), ref(holder_id)), reportNumber=series["number"],
        isPartOf=F.when(series.isNotNull(), F.struct(F.lit("CreativeWorkSeries").alias("@type"), series["value"].alias("name"))), identifier=some(numbered),
        spatialCoverage=named("AdministrativeArea", F.col("places")), isAccessibleForFree=F.lit(True), **accessibility(F.col("captioned")),
        encoding=F.array(media("application/pdf", F.concat(root, F.lit("/source"))), media("text/html", F.concat(root, F.lit("/exports/accessible.html")))),
        image=ref(image), mainEntityOfPage=ref(page_id), hasPart=some(parts),
    )
    # laws and cases are nodes, other citations plain texts, so their list is put in as it is
    report = F.when(cited == "", report).otherwise(F.concat(F.regexp_replace(report, r"\}$", ""), F.lit(',"citation":['), cited, F.lit("]}")))
    read = F.coalesce(page, F.concat(root, F.lit("/exports/accessible.html")))
    web_page = node(
        _type="WebPage", _id=page_id, url=page, name=F.concat(title, F.lit(f" - {site_name}" if site_name else "")), mainEntity=ref(report_id), isPartOf=F.when(F.lit(bool(site_url)), ref(F.lit(f"{site_url}/#website"))),
        breadcrumb=F.when(F.lit(bool(site_url)), ref(crumbs)), inLanguage=language, datePublished=F.col("generated_at"), dateModified=F.col("generated_at"), primaryImageOfPage=ref(image),
        potentialAction=F.array(F.struct(F.lit("ReadAction").alias("@type"), F.array(read).alias("target"))),
    )
    cover = F.concat(root, F.lit("/cover"))
    image_node = node(_type="ImageObject", _id=image, url=cover, contentUrl=cover, encodingFormat="image/png", caption=F.concat(F.lit("Cover of "), title), representativeOfPage=F.lit(True))
    graph = [report, web_page, image_node, F.array_join(F.transform(nodes, lambda o: F.to_json(o)), ",")]
    if site_url:
        graph.append(node(_type="WebSite", _id=f"{site_url}/#website", url=f"{site_url}/", name=text(site_name), publisher=F.when(owner, F.array(ref(org_id(F.lit(0))))), inLanguage=language))
        steps = F.array(F.struct(F.lit("ListItem").alias("@type"), F.lit(1).alias("position"), F.lit("Home").alias("name"), F.lit(f"{site_url}/").alias("item")), F.struct(F.lit("ListItem").alias("@type"), F.lit(2).alias("position"), title.alias("name"), F.lit(None).cast("string").alias("item")))
        graph.append(node(_type="BreadcrumbList", _id=crumbs, itemListElement=steps))
    listed = F.array_join(F.filter(F.array(*graph), lambda x: x != ""), ",")
    return d.select("doc_id", F.concat(F.lit('{"@context":"https://schema.org","@graph":['), listed, F.lit("]}")).alias("json"))


def footnote_targets(notes: DataFrame) -> DataFrame:
    """(doc_id, number, note_id): the first of notes(doc_id, ord, note_id) that bears a number in its id."""
    number = F.nullif(F.regexp_extract("note_id", r"(?i)^footnote-(\d+)(?:-|$)", 1), F.lit(""))
    return notes.withColumn("number", number).where("number is not null").groupBy("doc_id", "number").agg(F.min_by("note_id", "ord").alias("note_id"))


def figure_sources(figures: DataFrame, blocks: DataFrame) -> DataFrame:
    """figures(doc_id, figure, source_block_id) with page and bounds of their source blocks(doc_id, block_id, page, bounds), and the key of their image.

    Figures whose block is not there are left out.
    """
    own = blocks.select("doc_id", F.col("block_id").alias("source_block_id"), "page", "bounds")
    return figures.join(own, ["doc_id", "source_block_id"]).withColumn("image_key", evidence_key(F.col("source_block_id")))
