"""The pages that entries of a contents stand for, by one signal after another.

entries(doc_id, sequence, title, level, printed, target, contents_end), contents_end being the last page of the contents; labels(doc_id, page, label);
bookmarks(doc_id, title, page); lines(doc_id, page, pos, text, t); pages(doc_id, pages), the number of a document's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.functions.text import match_key
from pageloom.operators import layout
from pageloom.operators.contents import bookmark_targets
from pageloom.operators.sequential import with_keys
from pageloom.operators.similarity import likely_pairs, scored, signs_of, wanted_signs, with_marks
from pageloom.sources.settled import settled

#: The longest line that counts; thresholds of titles of up to two words, and of longer ones; the least length of a title that a page is searched for (fixed values).
LONGEST_LINE, SHORT_TITLE, LONG_TITLE, LEAST_KEY = 320, 0.9, 0.82, 8
#: How far a printed page may be off, and how many entries vote on it (fixed values).
OFFSETS, ANCHORS = (-10, 80), 16


def _number(printed: Column) -> Column:
    return F.when(printed.rlike(r"^[0-9]{1,9}$"), printed.try_cast("int"))


def _found(entries: DataFrame, found: DataFrame, source: str) -> DataFrame:
    """entries with found(doc_id, sequence, page, and a top if there is one) as the target of those that have none yet."""
    top = F.col("_top") if "top" in found.columns else F.lit(None).cast("double")
    own = found.withColumnsRenamed({"page": "_page", "top": "_top"})
    met, new = entries.join(own, ["doc_id", "sequence"], "left"), F.col("target").isNull() & F.col("_page").isNotNull()
    return met.withColumns({"target_top": F.when(new, top).otherwise(F.col("target_top")), "source": F.when(new, source).otherwise(F.col("source")), "target": F.coalesce("target", F.col("_page").cast("long"))}).select(*entries.columns)


def by_label(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """The first page after the contents whose label is the printed one."""
    wanted = entries.where("target is null and printed is not null").select("doc_id", F.lower("printed").alias("label"), "sequence", F.coalesce("contents_end", F.lit(0)).alias("end"))
    own = labels.select("doc_id", "page", F.lower("label").alias("label")).where("label <> ''")
    return wanted.join(own, ["doc_id", "label"]).where("page > end").groupBy("doc_id", "sequence").agg(F.min("page").alias("page"))


def by_offset(entries: DataFrame, offsets: DataFrame, pages: DataFrame) -> DataFrame:
    """Printed pages moved by the document's offset, as far as they lie after the contents and in the document."""
    met = entries.where("target is null").join(offsets.select("doc_id", "page_offset"), "doc_id").join(pages, "doc_id")
    moved = met.withColumn("page", _number(F.col("printed")) + F.col("page_offset"))
    return moved.where((F.col("page") > F.coalesce("contents_end", F.lit(0))) & (F.col("page") <= F.col("pages"))).select("doc_id", "sequence", "page")


def voted_offsets(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """The offset at which most of the first first-level entries stand on the pages whose text holds their titles."""
    keyed = with_keys(entries, "title", "keys").withColumn("number", _number(F.col("printed")))
    anchors = keyed.where((F.col("level") == 1) & F.col("number").isNotNull() & (F.size(F.split(match_key(F.col("title")), " ")) >= 2))
    first = anchors.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("sequence"))).where(F.col("n") <= ANCHORS)
    first = first.select("doc_id", "sequence", "keys", "number", F.coalesce("contents_end", F.lit(0)).alias("end"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    whole = lines.join(first.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id", "page").agg(match_key(F.array_join(F.transform(ordered, lambda x: x["text"]), " ")).alias("page_text"))
    # the few entries that vote meet the pages there are, instead of being written out for all pages that may be
    near = first.join(whole, "doc_id").where((F.col("page") > F.col("end")) & (F.col("page") - F.col("number")).between(*OFFSETS))
    stands = near.where(F.exists("keys", lambda k: (F.length(k) >= LEAST_KEY) & F.contains(F.col("page_text"), k)))
    return layout.offset_vote(first.select("doc_id", F.col("sequence").alias("ord"), F.col("sequence").alias("key"), F.col("number").alias("printed")), stands.select("doc_id", "page", F.col("sequence").alias("key")), *OFFSETS, ANCHORS)


def by_text(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """The earliest page after the contents on which the line most like the title is like enough, and that line's height.

    Titles and lines meet by an index of their lengths and words, and the pairs that a bound lets through are compared.
    """
    least = F.when(F.size(F.split(match_key(F.col("title")), " ")) <= 2, SHORT_TITLE).otherwise(LONG_TITLE)
    open_now = with_marks(entries.where("target is null"), "title", "entry_keys").select("doc_id", "sequence", "entry_keys", F.coalesce("contents_end", F.lit(0)).alias("end"), least.alias("least"))
    # lines of the contents, and those that share no sign with any title of their document, need no marks
    wanted = open_now.groupBy("doc_id").agg(F.min("end").alias("least_end"), F.array_distinct(F.flatten(F.collect_list(wanted_signs(F.col("entry_keys"), F.col("least"))))).alias("signs"))
    after = lines.where(F.length("text").between(1, LONGEST_LINE)).join(wanted, "doc_id").where(F.col("page") > F.col("least_end"))
    short = with_keys(after, "text", "keys").where(F.arrays_overlap(signs_of(F.col("keys")), "signs")).select("doc_id", "page", "pos", "t", "text")
    own = with_marks(short, "text", "line_keys").select("doc_id", "page", "pos", "t", "line_keys")
    pairs = likely_pairs(open_now, own, ["doc_id"], "entry_keys", "line_keys", F.col("least")).where(F.col("page") > F.col("end"))
    on_page = scored(pairs, "entry_keys", "line_keys", F.col("least")).groupBy("doc_id", "sequence", "page").agg(F.max_by("t", F.struct("score", -F.col("pos"))).alias("top"))
    return on_page.groupBy("doc_id", "sequence").agg(F.min(F.struct("page", "top")).alias("f")).select("doc_id", "sequence", "f.page", "f.top")


def located(entries: DataFrame, labels: DataFrame, bookmarks: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """entries with target, target_top and source, each target by the first of these that has one for it:

    `given`; `label`, the page so labelled; `offset`, the printed page moved by the middle difference of those that are known, or, where none is, by the
    difference on which most titles vote; `bookmark`, the bookmark most like the title; `text`, the line most like it.
    """
    known = entries.withColumns({"target": F.col("target").cast("long"), "target_top": F.lit(None).cast("double"), "source": F.when(F.col("target").isNotNull(), "given")})
    known = settled(_found(known, by_label(known, labels), "label"), "targets")  # each later step reads it several times
    pairs = known.select("doc_id", "target", _number(F.col("printed")).alias("printed")).where("target is not null and printed is not null")
    middle = layout.offset_median(pairs)
    vote = voted_offsets(known.join(middle, "doc_id", "left_anti"), lines).select("doc_id", "page_offset")
    offsets = settled(middle.unionByName(vote), "offsets")
    known = settled(_found(known, by_offset(known, offsets, pages), "offset"), "targets")
    expected = known.where("target is null").join(offsets, "doc_id", "left").select("doc_id", "sequence", "title", (_number(F.col("printed")) + F.col("page_offset")).alias("expected"), "contents_end")
    known = settled(_found(known, bookmark_targets(expected, bookmarks).withColumnRenamed("target", "page"), "bookmark"), "targets")
    return _found(known, by_text(known, lines), "text")
