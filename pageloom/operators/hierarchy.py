"""Contents pages and outlines: which pages are contents, what their rows say, and how the outline is mended.

lines(doc_id, page, pos, text); entries(doc_id, sequence, title, level, printed, page).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.functions.text import contents_row, match_key, roman_value

#: Headings of contents pages, as keys (fixed values).
CONTENTS = ("contents", "table of contents", "detailed contents")
SCAN_PAGES = 40


def contents_pages(lines: DataFrame, scan: int = SCAN_PAGES) -> DataFrame:
    """(doc_id, page) of the contents: from the first page with a contents heading and three rows on, while pages have the same or five rows."""
    rows = lines.where(F.col("page") <= scan).withColumn("row", contents_row(F.col("text")))
    pages = rows.groupBy("doc_id", "page").agg(F.count("row").alias("n"), F.max(match_key(F.col("text")).isin(*CONTENTS)).alias("headed"))
    starts = F.col("headed") & (F.col("n") >= 3)
    order = Window.partitionBy("doc_id").orderBy("page")
    first = pages.where(starts).groupBy("doc_id").agg(F.min("page").alias("first"))
    run = pages.where(starts | (F.col("n") >= 5)).join(first, "doc_id").where(F.col("page") >= F.col("first"))
    return run.withColumn("k", F.row_number().over(order)).where(F.col("page") - F.col("first") == F.col("k") - 1).select("doc_id", "page")


def contents_entries(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """The rows of contents pages, each title and printed page once, in order."""
    rows = lines.join(pages, ["doc_id", "page"]).withColumn("row", contents_row(F.col("text"))).where("row is not null")
    rows = rows.select("doc_id", "page", "pos", F.col("row.title").alias("title"), F.lower("row.page").alias("printed")).withColumn("key", match_key(F.col("title")))
    first = rows.groupBy("doc_id", "key", "printed").agg(F.min(F.struct("page", "pos", "title")).alias("f"))
    order = Window.partitionBy("doc_id").orderBy("f.page", "f.pos")
    return first.select("doc_id", (F.row_number().over(order) - 1).alias("sequence"), "f.title", "printed", "f.page")


def printed_number(printed):
    """A printed page as a number, whether decimal or roman."""
    return F.coalesce(F.try_to_number(printed, F.lit("9999")).cast("int"), roman_value(printed))


def first_headings(headings: DataFrame) -> DataFrame:
    """headings(doc_id, ord, page, text) without repeats of a key on a page; those without a key all stay."""
    keyed = headings.withColumn("key", match_key(F.col("text")))
    order = Window.partitionBy("doc_id", "page", "key").orderBy("ord")
    return keyed.withColumn("n", F.row_number().over(order)).where((F.col("n") == 1) | (F.col("key") == "")).drop("n", "key")


def chapters_once(chapters: DataFrame) -> DataFrame:
    """The earliest page of each chapter number."""
    return chapters.groupBy("doc_id", "number").agg(F.min("page").alias("page"), F.min_by("title", "page").alias("title"))


def numbers_complete(chapters: DataFrame) -> DataFrame:
    """Whether the chapter numbers of a document have no gap."""
    return chapters.groupBy("doc_id").agg((F.max("number") - F.min("number") + 1 == F.count_distinct("number")).alias("complete"))


def with_gaps_mended(entries: DataFrame, prominent: Column) -> DataFrame:
    """entries(doc_id, sequence, title, level, number, ...): between chapters n and m the first m - n - 1 prominent second-level rows become chapters."""
    order = Window.partitionBy("doc_id").orderBy("sequence")
    before = F.last("number", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("number", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    spans = entries.withColumns({"_before": before, "_after": after})
    candidate = F.col("number").isNull() & prominent & (F.col("level") == 2)
    nth = F.sum(candidate.cast("int")).over(Window.partitionBy("doc_id", "_before").orderBy("sequence"))
    made = candidate & (nth <= F.col("_after") - F.col("_before") - 1)
    spans = spans.withColumn("_made", F.when(made, F.col("_before") + nth))
    is_made, titled = F.col("_made").isNotNull(), F.concat(F.lit("Chapter "), F.col("_made").cast("string"), F.lit(": "), "title")
    return spans.withColumns({"title": F.when(is_made, titled).otherwise(F.col("title")), "level": F.when(is_made, 1).otherwise(F.col("level")), "number": F.coalesce("_made", "number")}).drop("_before", "_after", "_made")


def mended_gaps(entries: DataFrame) -> DataFrame:
    """entries(doc_id, sequence, title, level, number, prominent) with numbered gaps mended."""
    return with_gaps_mended(entries, F.col("prominent")).select("doc_id", "sequence", "title", "level", "number")


def demoted_inside(entries: DataFrame, chapters: DataFrame) -> DataFrame:
    """First-level entries(doc_id, sequence, level, target, is_chapter) between the first and the last chapter page, and next to none, go to level 2."""
    ends = chapters.groupBy("doc_id").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    near = chapters.select("doc_id", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)).alias("target")).distinct().withColumn("near", F.lit(True))
    met = entries.join(ends, "doc_id", "left").join(near, ["doc_id", "target"], "left")
    inside = (F.col("level") == 1) & (F.col("target") > F.col("first")) & (F.col("target") < F.col("last")) & F.col("near").isNull() & ~F.col("is_chapter")
    return met.withColumn("level", F.when(F.coalesce(inside, F.lit(False)), 2).otherwise(F.col("level"))).drop("first", "last", "near")


#: Patterns of rows of an outline (fixed values).
CHAPTER_ROW = r"(?i)^(?:(?:chapter|part)\s+(?:\d+|[ivxlcdm]+)\b|\d+[.)]\s+.+)"
RECOMMENDATIONS = r"(?i)^recommendations?\b"
APPENDIX = r"(?i)^appendix\s+(?:[a-z]|\d+|[ivxlcdm]+)\b"
ALWAYS_TOP = r"(?i)^(?:appendices|glossary(?:\s+of\b.*)?|bibliography|references|index)$"
NO_CHAPTER = r"(?i)^(?:recommendations?|introduction|summary|conclusion)"
STEP = 7.0
PANEL = r"(?i)^(?:recommendations?|case\s+stud(?:y|ies)(?:\s+\d+)?|example|note)$"
NUMBERED_BODY = r"^\s*(\d+(?:\.\d+){1,4})[.)]?\s+(\S.+)$"
NO_BODY = r"(?i)^(?:(?:figure|table)\s+\d+\s*[:.]|(?:isbn|issn|©|copyright)\b|(?:published|printed|ordered)\s+by\b|report\s+(?:january|february|march|april|may|june|july|august|september|october|november|december)\b)"


def heading_classes(title: Column) -> dict[str, Column]:
    """What the words of a heading say of it: panels, numbered headings of the body and their depth, and lines that are no headings of a body."""
    number = F.regexp_extract(title, NUMBERED_BODY, 1)
    return {
        "is_panel": title.rlike(PANEL),
        "is_body": ~title.rlike(NO_BODY),
        "is_appendix": title.rlike(APPENDIX),
        "always_top": title.rlike(ALWAYS_TOP),
        "body_number": F.nullif(number, F.lit("")),
        "depth": F.when(number != "", F.size(F.split(number, r"\."))),
    }


def outline_levels(entries: DataFrame) -> DataFrame:
    """entries(doc_id, sequence, title, level, indent, printed, prominent) with levels 1 to 3 and sequences counted anew.

    Chapters are first-level. After the first one, recommendations and rows that are clearly further in than the last chapter
    are second-level, and so are appendices, before the first of which `Appendices` is put in where the document has no such row. Numbered gaps
    are mended, and under each first-level row those further in than its first tier become third-level.
    """
    order = Window.partitionBy("doc_id").orderBy("sequence")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("doc_id")
    title, indent = F.col("title"), F.col("indent")
    chapter = title.rlike(CHAPTER_ROW)
    rows = entries.withColumn("top_indent", F.last(F.when(chapter, indent), ignorenulls=True).over(before))
    started = F.col("top_indent").isNotNull()
    inner = (F.col("level") == 1) & (indent > F.col("top_indent") + STEP) & ~title.rlike(ALWAYS_TOP)
    level = F.when(chapter, 1).when(started & (title.rlike(RECOMMENDATIONS) | inner), 2).otherwise(F.col("level"))
    rows = rows.withColumns({"level": level, "appendix": title.rlike(APPENDIX), "named": F.max(match_key(title).isin("appendix", "appendices")).over(whole)}).drop("top_indent")
    rows = rows.withColumn("part", F.sum(((F.col("level") == 1) & ~F.col("appendix")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.sum(F.col("appendix").cast("int")).over(Window.partitionBy("doc_id", "part").orderBy("sequence"))
    rows = rows.withColumn("heads", F.col("appendix") & (nth == 1) & ~F.col("named"))
    rows = rows.withColumn("level", F.when((F.col("level") == 1) & ~F.col("appendix"), 1).otherwise(2))
    rows = rows.withColumn("sequence", F.col("sequence").cast("double"))
    # rows are put in, mended and given their tiers without leaving their document, so that they are shuffled once
    held = [c for c in entries.columns if c != "doc_id"]
    new = {"title": F.lit("Appendices"), "level": F.lit(1), "sequence": F.col("sequence") - 0.5, "prominent": F.lit(False)}
    own, put_in = (F.struct(*[values.get(c, F.col(c)).alias(c) for c in held]) for values in ({}, new))
    rows = rows.select("doc_id", F.explode(F.when(F.col("heads"), F.array(put_in, own)).otherwise(F.array(own))).alias("r")).select("doc_id", "r.*")
    number = F.regexp_extract("title", r"(?i)^chapter\s+(\d+)\b", 1)
    likely = F.col("prominent") & F.coalesce(F.col("printed").rlike(r"^\d+$"), F.lit(False)) & ~title.rlike(NO_CHAPTER)
    rows = with_gaps_mended(rows.withColumn("number", F.nullif(number, F.lit("")).cast("int")), likely).withColumn("level", F.col("level").cast("int")).drop("number")
    rows = rows.withColumn("parent", F.sum((F.col("level") == 1).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    tiers = rows.where((F.col("level") != 1) & (F.col("parent") > 0)).groupBy("doc_id", "parent").agg(first_tier(F.array_sort(F.collect_list(F.col("indent").cast("double")))).alias("tier"))
    by_document = tiers.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("parent", "tier"))).alias("tiers"))
    rows = rows.join(by_document, "doc_id", "left").withColumn("tier", F.try_element_at("tiers", "parent")).drop("tiers")
    deep = (F.col("level") != 1) & (F.col("indent") > F.col("tier") + STEP)
    return rows.withColumn("level", F.when(F.coalesce(deep, F.lit(False)), 3).otherwise(F.col("level"))).withColumn("sequence", F.row_number().over(order) - 1).drop("parent", "tier")


def first_tier(sorted_indents, tolerance: float = STEP):
    """The median of the first run of sorted values, each within the tolerance of the median of the run so far."""

    def middle(run):
        n = F.size(run)
        return (F.get(run, F.floor((n - 1) / 2).cast("int")) + F.get(run, F.floor(n / 2).cast("int"))) / 2

    def step(state, value):
        joins = ~state["ended"] & ((F.size(state["run"]) == 0) | (value - middle(state["run"]) <= tolerance))
        return F.struct(F.when(joins, F.concat(state["run"], F.array(value))).otherwise(state["run"]).alias("run"), (~joins).alias("ended"))

    start = F.struct(F.array().cast("array<double>").alias("run"), F.lit(False).alias("ended"))
    return F.aggregate(sorted_indents, start, step, lambda s: middle(s["run"]))
