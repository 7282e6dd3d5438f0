"""The review queue: which blocks need review, patches, bulk changes, coverage and confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.functions import tables
from pageloom.functions.text import list_entries, single_line
from pageloom.operators.audit import action_label

OPEN = ("pending", "needs_attention")
#: Characters of a block's text that an item keeps as evidence.
SNIPPET = 1800
TABLES = ("table", "document_index")
#: Labels whose text is one line.
SINGLE_LINE = ("title", "caption", "section_header_1", "section_header_2", "section_header_3", "section_header_4", "section_header_5")


@dataclass(frozen=True)
class Thresholds:
    """Confidence at and over which a block counts as high, or as medium."""

    high: float = 0.75
    medium: float = 0.55

    def __post_init__(self) -> None:
        if not 0 <= self.medium < self.high <= 1:
            raise ValueError("thresholds must satisfy 0 <= medium < high <= 1")


def confidence_band(score: Column, at: Thresholds = Thresholds()) -> Column:
    return F.when(score >= at.high, "high").when(score >= at.medium, "med").otherwise("low")


def category(label: Column) -> Column:
    """headings, images or tables; null for other labels."""
    return F.when(F.startswith(label, F.lit("section_header_")), "headings").when(label == "picture", "images").when(label == "table", "tables")


def review_queue(blocks: DataFrame, at: Thresholds = Thresholds()) -> DataFrame:
    """Items for blocks(doc_id, block_id, label, text, page, confidence, ord, has_table, has_bounds) that need review.

    A null confidence counts as one half. Numbers run densely over the items of a document, in block order.
    """
    sure = F.coalesce("confidence", F.lit(0.5))
    empty = (F.trim(F.coalesce("text", F.lit(""))) == "") & ~F.col("has_table") & ~F.col("has_bounds")
    items = blocks.where(~F.coalesce("label", F.lit("unspecified")).isin("header", "footer") & (sure < at.high) & ~empty)
    order = Window.partitionBy("doc_id").orderBy("ord")
    kind = F.when(F.col("label").isin("table", "document_index"), "table").otherwise("text")
    return items.select(
        "doc_id",
        F.concat(F.lit("review-"), F.row_number().over(order).cast("string")).alias("item_id"),
        "block_id",
        F.coalesce("label", F.lit("unspecified")).alias("type"),
        F.coalesce("page", F.lit(1)).alias("page"),
        F.bround(sure, 4).alias("confidence"),
        F.when(sure >= at.medium, "med").otherwise("low").alias("band"),
        kind.alias("kind"),
        F.lit("pending").alias("status"),
        F.when(kind == "text", F.col("text")).alias("extracted_text"),
        F.substring("text", 1, SNIPPET).alias("evidence"),
        F.col("ord").alias("original_index"),
    )


def sort_key(how: str) -> list[Column]:
    """Order of the queue: by page (usual), or by confidence up or down; ties keep the original order."""
    first = {"page": F.col("page").asc(), "confidence_desc": F.col("confidence").desc(), "confidence_asc": F.col("confidence").asc()}[how]
    return [F.col("doc_id"), first, F.col("original_index")]


def filter_items(items: DataFrame, status: str | None = None, kind: str | None = None, text: str = "", columns: tuple[str, ...] = ("type", "extracted_text")) -> DataFrame:
    """Items by status, type and a piece of any of the columns: texts, arrays of texts (key-value pairs) or tables(headers, rows)."""
    if status is not None:
        items = items.where(F.col("status") == status)
    if kind is not None:
        items = items.where(F.col("type") == kind)
    if text.strip():
        wanted, found = F.lit(text.strip().lower()), F.lit(False)
        holds = lambda v: F.coalesce(F.contains(F.lower(v), wanted), F.lit(False))
        for c in columns:
            shape = items.schema[c].dataType.simpleString()
            if shape == "string":
                found = found | holds(F.col(c))
            else:
                values = F.flatten(F.concat(F.array(F.col(c)["headers"]), F.col(c)["rows"])) if shape.startswith("struct") else F.col(c)
                found = found | F.coalesce(F.exists(values, holds), F.lit(False))
        items = items.where(found)
    return items


def merged_patches(patches: DataFrame, order: str = "ord", content: tuple[str, ...] = ("type", "corrected_text", "corrected_table")) -> DataFrame:
    """One row for each item of patches(doc_id, item_id, status and content columns), as if they came one after another in the order of a column.

    Each column has the last value given. A patch without a status that changes content sets the status `edited`. Without such a column, patches come in the order
    of their values.
    """
    held = [c for c in content if c in patches.columns]
    step = F.col(order) if order in patches.columns else F.struct("status", *held)
    changes = F.lit(False)
    for c in held:
        changes = changes | F.col(c).isNotNull()
    status = F.coalesce("status", F.when(changes, F.lit("edited")))
    last = lambda value: F.max_by(value, F.when(value.isNotNull(), step))
    return patches.groupBy("doc_id", "item_id").agg(last(status).alias("status"), *[last(F.col(c)).alias(c) for c in held])


def apply_patches(items: DataFrame, patches: DataFrame, order: str = "ord") -> DataFrame:
    """items with patches(doc_id, item_id, status, type, corrected_text) laid over them.

    Several patches of an item are merged in the order of a column. A given status stands; otherwise an item with changed content becomes `edited`. removed
    follows from the status, and a correction made before stands where a patch has none. A document's patches are applied only if items exist for all of them.
    """
    refused = unknown_ids(items, patches).select("doc_id").distinct()
    patches = merged_patches(patches.join(refused, "doc_id", "left_anti"), order)
    p = patches.select("doc_id", "item_id", F.col("status").alias("new_status"), F.col("type").alias("new_type"), F.col("corrected_text").alias("new_text"))
    met = items.join(p, ["doc_id", "item_id"], "left")
    status = F.coalesce("new_status", "status")
    before = F.col("corrected_text") if "corrected_text" in items.columns else F.lit(None).cast("string")
    out = met.withColumns({"status": status, "type": F.coalesce("new_type", "type"), "corrected_text": F.coalesce("new_text", before)})
    return out.withColumn("removed", F.col("status") == "removed").drop("new_status", "new_type", "new_text")


def patched_content(target: Column, original: Column, text: Column, table: Column, block_text: Column, block_table: Column, block_entries: Column) -> Column:
    """What a block holds once its type is `target`: struct(kind, text, table, entries, boxed).

    text and table are the corrections, or null; the block's own text, table and list entries stand in for them. A table's text is its
    rows at pipes; a list's text is a line an entry; a text is made of a table that the block had, and headings and captions are one line. A block
    that becomes a box keeps what it was, boxed under its original type.
    """
    is_table, is_box, is_list = target.isin(*TABLES), target == "box_section", target == "list"
    held = F.coalesce(table, block_table, tables.table_of(F.coalesce(F.nullif(text, F.lit("")), block_text)))
    marked = F.when(block_table.isNotNull(), F.nullif(tables.to_list(block_table), F.array().cast("array<struct<text:string,marker:string,enumerated:boolean,level:int>>")))
    from_block = F.coalesce(F.when((original == "list") & (F.size(block_entries) > 0), block_entries), marked, list_entries(block_text))
    entries = F.when(text.isNotNull(), list_entries(text)).otherwise(from_block)
    listed = F.array_join(F.transform(F.filter(entries, lambda e: F.trim(e["text"]) != ""), lambda e: F.trim(F.concat_ws(" ", F.coalesce(e["marker"], F.lit("")), e["text"]))), "\n")
    of_table = F.when(target == "form", tables.to_form(block_table)).when(target == "footnote", tables.to_footnote(block_table)).otherwise(tables.to_text(block_table))
    plain = F.coalesce(text, F.when(block_table.isNotNull(), of_table), block_text)
    plain = F.when(target.isin(*SINGLE_LINE), single_line(plain)).otherwise(plain)
    boxed = F.when(is_box & (original != "box_section"), original)
    new_text = F.when(is_box, F.trim(F.coalesce(text, block_text))).when(is_table, tables.plain_text(held)).when(is_list, listed).otherwise(plain)
    return F.struct(F.when(is_table, "table").otherwise("text").alias("kind"), new_text.alias("text"), F.when(is_table, held).alias("table"), F.when(is_list, entries).alias("entries"), boxed.alias("boxed"))


def withdrawn(records: DataFrame, edited: DataFrame) -> DataFrame:
    """records without approval where edited(doc_id) has a document, as its generated outputs no longer hold."""
    hit = edited.select(F.col("doc_id").alias("id"), F.lit(True).alias("_hit")).distinct()
    met = records.join(hit, "id", "left")
    return met.withColumn("approved_at", F.when(F.col("_hit").isNull(), F.col("approved_at"))).drop("_hit").select(*records.columns)


def approved(records: DataFrame, items: DataFrame, metadata: DataFrame, at: Column) -> DataFrame:
    """records with approval where nothing stands against it, and the reason where something does.

    metadata(doc_id, title, publisher); records(id, metadata_confirmed, approved_at).
    """
    from pageloom.operators.scope import approval_gate

    waiting = items.groupBy(F.col("doc_id").alias("id")).agg(F.count_if(F.col("status").isin(*OPEN)).alias("_open"))
    met = records.join(waiting, "id", "left").join(metadata.select(F.col("doc_id").alias("id"), F.col("title").alias("_title"), F.col("publisher").alias("_publisher")), "id", "left")
    reason = approval_gate(F.col("_open"), F.col("metadata_confirmed"), F.col("_title"), F.col("_publisher"))
    return met.withColumn("reason", reason).withColumn("approved_at", F.when(F.col("reason").isNull(), at)).select(*records.columns, "reason")


def metadata_saved(records: DataFrame, metadata: DataFrame) -> DataFrame:
    """records with title and publisher of saved metadata(doc_id, title, publisher), confirmed and no longer approved; empty values change nothing."""
    own = metadata.select(F.col("doc_id").alias("id"), F.nullif("title", F.lit("")).alias("_title"), F.nullif("publisher", F.lit("")).alias("_publisher"), F.lit(True).alias("_hit"))
    met, hit = records.join(own, "id", "left"), F.col("_hit").isNotNull()
    return met.withColumns({
        "title": F.coalesce("_title", "title"),
        "publisher": F.coalesce("_publisher", "publisher"),
        "metadata_confirmed": F.when(hit, True).otherwise(F.col("metadata_confirmed")),
        "approved_at": F.when(~hit, F.col("approved_at")),
    }).select(*records.columns)


def progress(documents: DataFrame, items: DataFrame) -> DataFrame:
    """pending and resolved items, what must be checked by hand, and readiness, of each of documents(doc_id, citations, metadata_confirmed)."""
    each = items.groupBy("doc_id").agg(
        F.count_if(F.col("status").isin(*OPEN)).alias("pending"), F.count("*").alias("items"), F.bool_or(F.col("type").isin(*TABLES, "box_section", "picture")).alias("visual")
    )
    met = documents.join(each, "doc_id", "left").withColumn("pending", F.coalesce("pending", F.lit(0)))
    checks = F.array_compact(F.array(F.lit("content"), F.when(F.col("visual"), "tables"), F.when(F.trim("citations") != "", "citations")))
    return met.select("doc_id", "pending", (F.coalesce("items", F.lit(0)) - F.col("pending")).alias("resolved"), checks.alias("checks"), ((F.col("pending") == 0) & F.col("metadata_confirmed")).alias("ready"))


def fields_to_review(fields: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Of fields(doc_id, field, value, band, approved): those that are required and blank, and those of no high band that nobody approved."""
    wrong = F.col("field").isin(*required) & (F.trim(F.coalesce("value", F.lit(""))) == "")
    return fields.where(wrong | ((F.col("band") != "high") & ~F.col("approved"))).select("doc_id", "field", "band")


def own_history(log: DataFrame, actor: str, action: str | None = None, text: str = "") -> DataFrame:
    """An actor's entries by action and a piece of the action's label."""
    rows = log.where(F.col("actor_id") == actor).withColumn("label", action_label(F.col("action")))
    if action is not None:
        rows = rows.where(F.col("action") == action)
    return rows.where(F.contains(F.lower("label"), F.lit(text.strip().lower())))


def next_selected(before: DataFrame, after: DataFrame, selected: DataFrame) -> DataFrame:
    """(doc_id, item_id) to select once the lists change from before to after(doc_id, item_id, position): the selected item if it is still there,
    else the next of the old list that is, else the nearest earlier one, else the first of the new list."""
    left = before.join(after.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi")
    at = before.join(selected.select("doc_id", "item_id"), ["doc_id", "item_id"]).select("doc_id", F.col("position").alias("_at"))
    steps = left.join(at, "doc_id").withColumn("_step", F.col("position") - F.col("_at"))
    kept = steps.groupBy("doc_id").agg(F.min_by("item_id", F.struct((F.col("_step") < 0).alias("back"), F.abs("_step").alias("steps"))).alias("_kept"))
    first = after.groupBy("doc_id").agg(F.min_by("item_id", "position").alias("_first"))
    return first.join(kept, "doc_id", "left").select("doc_id", F.coalesce("_kept", "_first").alias("item_id"))


def between(items: DataFrame, anchors: DataFrame) -> DataFrame:
    """The items(doc_id, item_id, position) from one item of anchors(doc_id, first_id, second_id) to the other, in either order."""
    ends = anchors.select("doc_id", F.explode(F.array("first_id", "second_id")).alias("item_id")).join(items, ["doc_id", "item_id"])
    span = ends.groupBy("doc_id").agg(F.min("position").alias("_low"), F.max("position").alias("_high"))
    return items.join(span, "doc_id").where(F.col("position").between(F.col("_low"), F.col("_high"))).select("doc_id", "item_id")


def unknown_ids(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids of a bulk change that no item has; the change applies only if there are none."""
    return wanted.select("doc_id", "item_id").distinct().join(items, ["doc_id", "item_id"], "left_anti")


def resolve_all(items: DataFrame) -> DataFrame:
    return items.withColumn("status", F.when(F.col("status").isin(*OPEN), "accepted").otherwise(F.col("status")))


def coverage(blocks: DataFrame, items: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """For each document and category: distinct blocks, those with open items (no more than there are), and the rest.

    blocks may hold children, an array of struct(block_id, label) of the blocks in a box; pages(doc_id, pages) adds a row of pages.
    """
    every = blocks.select("doc_id", "block_id", "label")
    if "children" in blocks.columns:
        every = every.union(blocks.select("doc_id", F.explode("children").alias("c")).select("doc_id", "c.block_id", "c.label"))
    totals = every.withColumn("category", category(F.col("label"))).where("category is not null").groupBy("doc_id", "category").agg(F.count_distinct("block_id").alias("total"))
    waiting = items.where(F.col("status").isin(*OPEN)).withColumn("category", category(F.col("type"))).where("category is not null")
    waiting = waiting.groupBy("doc_id", "category").agg(F.count_distinct("block_id").alias("waiting"))
    met = totals.join(waiting, ["doc_id", "category"], "left")
    needs = F.least("total", F.coalesce("waiting", F.lit(0)))
    out = met.select("doc_id", "category", "total", (F.col("total") - needs).alias("detected"), needs.alias("needs_review"))
    if pages is not None:
        n = F.greatest(F.lit(0), F.coalesce("pages", F.lit(0))).cast("bigint")
        out = out.union(pages.select("doc_id", F.lit("pages"), n, n, F.lit(0).cast("bigint")))
    return out


def document_confidence(blocks: DataFrame, model: DataFrame | None = None, at: Thresholds = Thresholds()) -> DataFrame:
    """The model's mean score(doc_id, mean_score) of a document, else the mean of its blocks' known confidences, to four places, half to even."""
    each = blocks.groupBy("doc_id").agg(F.avg("confidence").alias("of_blocks"), F.count("confidence").alias("scored_blocks"))
    if model is None:
        return each.select("doc_id", F.bround("of_blocks", 4).alias("confidence"), "scored_blocks")
    met = each.join(model.select("doc_id", "mean_score"), "doc_id", "full")
    score = F.coalesce("mean_score", "of_blocks")
    source = F.when(F.col("mean_score").isNotNull(), "document").when(F.col("of_blocks").isNotNull(), "blocks")
    return met.select("doc_id", F.bround(score, 4).alias("confidence"), F.when(score.isNotNull(), confidence_band(score, at)).alias("band"), source.alias("source"))
