"""Edits of a review as one change: items, their blocks, approval and generated outputs together, written by touched buckets only.

items(doc_id, item_id, block_id, type, status, corrected_text, corrected_table); blocks(doc_id, block_id, label, text, table_data, list_entries, box_title,
box_kind, children, removed); records(id, approved_at); artifacts(document_id, name, value).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators import review
from pageloom.sources.records import GENERATED, artifacts_deleted
from pageloom.sources.settled import settled

TABLE = "struct<headers:array<string>,rows:array<array<string>>>"
ENTRIES = "array<struct<text:string,marker:string,enumerated:boolean,level:int>>"
CHILDREN = "array<struct<label:string,text:string>>"
#: Of a block that is put into a box (fixed values).
BOX_TITLE, BOX_KIND = "Box Section", "information"
#: Parts of a stored table; a document lies in one of them.
BUCKETS = 256
TABLES = {"items": "doc_id", "blocks": "doc_id", "records": "id", "artifacts": "document_id"}


class Edited(NamedTuple):
    items: DataFrame
    blocks: DataFrame
    records: DataFrame
    artifacts: DataFrame


def accepted(items: DataFrame, blocks: DataFrame, patches: DataFrame, order: str = "ord") -> DataFrame:
    """One merged patch an item, with the item's block and type; a document's patches go if one of them names an item that has no row or no block."""
    known = items.join(blocks.select("doc_id", "block_id"), ["doc_id", "block_id"], "left_semi")
    refused = review.unknown_ids(known, patches).select("doc_id").distinct()
    merged = review.merged_patches(patches.join(refused, "doc_id", "left_anti"), order)
    for column, kind in (("type", "string"), ("corrected_text", "string"), ("corrected_table", TABLE)):
        if column not in merged.columns:
            merged = merged.withColumn(column, F.lit(None).cast(kind))
    own = known.select("doc_id", "item_id", "block_id", F.col("type").alias("old_type"), F.col("status").alias("old_status"))
    return own.join(merged.withColumnsRenamed({"type": "new_type", "status": "new_status"}), ["doc_id", "item_id"]).withColumns({"target": F.coalesce("new_type", "old_type"), "now": F.coalesce("new_status", "old_status")}).drop("old_type", "new_type", "old_status", "new_status")


def boxed_children(boxes: Column, text: Column) -> Column:
    """The children of a box: what it holds, or, of a block that becomes one, the block as it was; a corrected text is that of an only child."""
    own = F.when(F.col("label") == "box_section", F.coalesce("children", F.array().cast(CHILDREN))).otherwise(F.array(F.struct("label", "text")))
    said = F.when(text.isNotNull() & (F.size(own) == 1), F.transform(own, lambda c: F.struct(c["label"].alias("label"), text.alias("text")))).otherwise(own)
    return F.when(boxes, said)


def edited_blocks(blocks: DataFrame, changes: DataFrame) -> DataFrame:
    """blocks as their items' changes(doc_id, block_id, target, now, corrected_text, corrected_table) leave them, with kind: whether text or table counts."""
    met = blocks.join(changes.select("doc_id", "block_id", "target", "now", "corrected_text", "corrected_table"), ["doc_id", "block_id"], "left")
    hit, boxes = F.col("target").isNotNull(), F.col("target") == "box_section"
    content = review.patched_content(F.col("target"), F.col("label"), F.col("corrected_text"), F.col("corrected_table"), F.col("text"), F.col("table_data"), F.col("list_entries"))
    met = met.withColumns({"content": F.when(hit, content), "inner": boxed_children(boxes, F.col("corrected_text"))})
    texts = F.filter(F.transform("inner", lambda c: F.trim(F.coalesce(c["text"], F.lit("")))), lambda t: t != "")
    own = lambda value, column: F.when(hit, value).otherwise(F.col(column)).alias(column)
    return met.select(
        "doc_id", "block_id", own(F.col("target"), "label"), own(F.when(boxes, F.array_join(texts, "\n\n")).otherwise(F.col("content.text")), "text"), own(F.col("content.table"), "table_data"), own(F.col("content.entries"), "list_entries"),
        own(F.when(boxes, F.when(F.col("label") == "box_section", F.col("box_title")).otherwise(BOX_TITLE)), "box_title"), own(F.when(boxes, F.when(F.col("label") == "box_section", F.col("box_kind")).otherwise(BOX_KIND)), "box_kind"), own(F.col("inner"), "children"), own(F.col("now") == "removed", "removed"),
        F.col("content.kind").alias("kind"),
    )


def edited(items: DataFrame, blocks: DataFrame, records: DataFrame, artifacts: DataFrame, patches: DataFrame, order: str = "ord") -> Edited:
    """All four tables after patches(doc_id, item_id, status, type, corrected_text, corrected_table, and a column of order).

    Patches of one item are merged in their order. The item takes its type and status, and its correction from the block: the text as it has become, or the table.
    Documents with an accepted patch lose their approval and the outputs that approval made.
    """
    changes = accepted(items, blocks, patches, order)
    after = edited_blocks(blocks, changes)
    content = after.select("doc_id", "block_id", "kind", F.col("text").alias("block_text"), F.col("table_data").alias("block_table"))
    said = changes.select("doc_id", "item_id", "block_id", "target", "now").join(content, ["doc_id", "block_id"]).drop("block_id")
    met, hit, tabled = items.join(said, ["doc_id", "item_id"], "left"), F.col("target").isNotNull(), F.col("kind") == "table"
    own = lambda value, column: F.when(hit, value).otherwise(F.col(column))
    now = met.withColumns({"type": own(F.col("target"), "type"), "status": own(F.col("now"), "status"), "corrected_text": own(F.when(~tabled, F.col("block_text")), "corrected_text"), "corrected_table": own(F.when(tabled, F.col("block_table")), "corrected_table")})
    docs = changes.select("doc_id").distinct()
    return Edited(now.select(*items.columns), after.drop("kind"), review.withdrawn(records, docs), artifacts_deleted(artifacts, docs.withColumnRenamed("doc_id", "document_id"), GENERATED))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def write_tables(tables: Edited, path: str, buckets: int = BUCKETS) -> None:
    """The tables under a path, outputs and approval first; of what is there, only the buckets that the tables have rows for are replaced."""
    for name in reversed(TABLES):
        rows = getattr(tables, name).withColumn("bucket", bucket_of(F.col(TABLES[name]), buckets))
        rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{name}")


def stored(spark: SparkSession, path: str, only: list[int] | None = None) -> Edited:
    """The tables under a path, or those buckets of them; others aren't read."""
    frames = (spark.read.parquet(f"{path}/{name}") for name in TABLES)
    return Edited(*((f if only is None else f.where(F.col("bucket").isin(only))).drop("bucket") for f in frames))


def edit_stored(spark: SparkSession, path: str, patches: DataFrame, buckets: int = BUCKETS, order: str = "ord") -> list[int]:
    """Applies patches to the stored tables, rewriting the touched buckets only; returns these.

    All four results are settled before the first is written, and outputs and approval go first: whatever is lost after that, nothing approved stands for
    blocks that have changed, and the call may be repeated. The buckets' numbers come to the driver, BUCKETS at most.
    """
    touched = sorted(r[0] for r in patches.select(bucket_of(F.col("doc_id"), buckets)).distinct().collect())
    if touched:
        after = edited(*stored(spark, path, touched), patches, order)
        write_tables(Edited(*(settled(df, f"edited_{name}") for name, df in after._asdict().items())), path, buckets)
    return touched
