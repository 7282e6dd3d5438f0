"""Audit feed: newest entries, hash-chain status, search and overview."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Action -> (label, tone): fixed display values.
ACTIONS = {
    "upload": ("Uploaded document", "info"),
    "delete_document": ("Deleted document", "low"),
    "process_start": ("Started processing", "info"),
    "process_stop": ("Stopped processing", "neutral"),
    "process_failed": ("Processing failed", "low"),
    "edit_review_item": ("Edited review item", "med"),
    "edit_metadata": ("Edited metadata", "med"),
    "approve": ("Approved document", "high"),
    "revoke_approval": ("Revoked approval", "med"),
}
GENESIS = "0" * 64
#: Ids in one link of the chain window, see chain_status.
CHAIN_RANGE = 65_536
#: Ranges in one group of ranges.
GROUP = 4_096


def _looked_up(key: Column, at: int) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v[at])) for k, v in ACTIONS.items()))
    return F.element_at(table, key)


def action_label(action: Column) -> Column:
    return F.coalesce(_looked_up(action, 0), action)


def action_tone(action: Column) -> Column:
    return F.coalesce(_looked_up(action, 1), F.lit("neutral"))


def entry_summary(action: Column, detail: Column) -> Column:
    """The one fact of an entry to show in a list; detail is JSON text."""
    dash = F.lit("—")
    text = lambda k: F.get_json_object(detail, f"$.{k}")
    items = F.from_json(F.get_json_object(detail, "$.items"), "array<string>")
    resolved = F.coalesce(text("resolve_all") == "true", F.lit(False))
    n = F.size(items).cast("string")
    review = (
        F.when(text("item").isNotNull(), text("item"))
        .when(F.size(items) > 0, F.when(resolved, F.concat(n, F.lit(" items resolved"))).otherwise(F.concat(n, F.lit(" items"))))
        .when(resolved, F.concat(F.coalesce(text("count"), F.lit("all")), F.lit(" items resolved")))
        .otherwise(dash)
    )
    failed = F.concat_ws(" — ", text("file_name"), text("error"))
    by_file = action.isin("upload", "delete_document", "process_start", "process_stop", "approve", "revoke_approval")
    return (
        F.when(by_file, F.coalesce(text("file_name"), dash))
        .when(action == "edit_metadata", F.coalesce(F.concat(F.lit("Title: "), text("title")), dash))
        .when(action == "edit_review_item", review)
        .when(action == "process_failed", F.when(failed == "", dash).otherwise(failed))
        .otherwise(dash)
    )


def recent(log: DataFrame, n: int = 100, actor: str | None = None) -> DataFrame:
    """The newest entries, of one actor if given; plans as a top-n without a full sort."""
    if actor is not None:
        log = log.where(F.col("actor_id") == actor)
    return log.orderBy(F.desc("id")).limit(n)


def chain_status(log: DataFrame, range_size: int = CHAIN_RANGE) -> DataFrame:
    """log with chain_status: whether prev_hash is the entry_hash of the entry with the next smaller id.

    A window over the whole log would run in one task, so neighbours are looked up inside ranges of ids;
    only the first entry of each range needs the last of the nearest earlier range that has any, from a table of one row a range. That
    table is looked up inside groups of ranges in turn, so that the one window without a key has a row for each range_size * GROUP ids.
    """
    ranged = log.withColumn("_range", F.floor(F.col("id") / range_size))
    inside = Window.partitionBy("_range").orderBy("id")
    ranged = ranged.withColumn("_before", F.lag(F.struct("id", "entry_hash")).over(inside))
    lasts = ranged.groupBy("_range").agg(F.max_by(F.struct("id", "entry_hash"), "id").alias("_last"))
    lasts = lasts.withColumn("_group", F.floor(F.col("_range") / GROUP))
    lasts = lasts.withColumn("_near", F.lag("_last").over(Window.partitionBy("_group").orderBy("_range")))
    groups = lasts.groupBy("_group").agg(F.max_by("_last", "_range").alias("_final"))
    groups = groups.withColumn("_far", F.lag("_final").over(Window.orderBy("_group"))).select("_group", "_far")
    earlier = lasts.join(groups, "_group").select("_range", F.coalesce("_near", "_far").alias("_earlier"))
    joined = ranged.join(earlier, "_range")
    before = F.coalesce("_before", "_earlier")
    own, previous = F.nullif(F.col("entry_hash"), F.lit("")), F.nullif(F.col("prev_hash"), F.lit(""))
    status = (
        F.when(own.isNull() | previous.isNull(), "unverifiable")
        .when(before.isNull(), F.when(previous == GENESIS, "linked").otherwise("unverifiable"))
        .when(F.nullif(before["entry_hash"], F.lit("")).isNull(), "unverifiable")
        .when(previous == before["entry_hash"], "linked")
        .otherwise("broken")
    )
    return joined.withColumn("chain_status", status).drop("_range", "_before", "_earlier")


def search(log: DataFrame, documents: DataFrame, text: str = "", action: str | None = None, actor: str | None = None, status: str | None = None) -> DataFrame:
    """Entries with their document's title, filtered after their chain status is known."""
    rows = chain_status(log).join(documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title")), "document_id", "left")
    for column, wanted in (("action", action), ("actor_email", actor), ("chain_status", status)):
        if wanted is not None:
            rows = rows.where(F.col(column) == wanted)
    if text.strip():
        haystack = F.lower(F.concat_ws(" ", F.coalesce("actor_email", F.lit("")), F.coalesce("document_title", "document_id", F.lit("")), action_label(F.col("action"))))
        rows = rows.where(F.contains(haystack, F.lit(text.strip().lower())))
    return rows


def overview(documents: DataFrame, log: DataFrame) -> DataFrame:
    """One row: documents in all, those that wait for approval, failures, contributors, broken links and events."""
    waiting = (F.col("state") == "complete") & F.col("approved_at").isNull()
    docs = documents.agg(
        F.count("*").alias("documents"),
        F.count_if(waiting).alias("awaiting_approval"),
        F.count_if(F.col("state") == "failed").alias("failures"),
        F.count_distinct(F.nullif(F.col("uploaded_by"), F.lit(""))).alias("contributors"),
    )
    events = chain_status(log).agg(F.count_if(F.col("chain_status") == "broken").alias("broken_links"), F.count("*").alias("events"))
    both = docs.unionByName(events, allowMissingColumns=True)  # one row each, put together without a join
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def uploads(log: DataFrame) -> DataFrame:
    """What each upload entry says of its document, with defaults for what it doesn't say."""
    name = F.get_json_object("detail", "$.file_name")
    pages = F.get_json_object("detail", "$.pages").try_cast("bigint")
    return log.where(F.col("action") == "upload").select("document_id", F.coalesce(name, F.lit("Unknown file")).alias("file_name"), pages.alias("pages"), F.col("created_at").alias("uploaded_at"))


def change_rows(changes: DataFrame) -> DataFrame:
    """(id, field, before, after) for each field of the after map, with the value before where there was one."""
    return changes.select("id", F.explode("after").alias("field", "after_value"), "before").select(
        "id", "field", F.try_element_at("before", F.col("field")).alias("before_value"), "after_value"
    )


def changed_fields(before: Column, after: Column) -> Column:
    """The entries of the map after whose value is not that of before, null being a value, too."""
    return F.map_filter(after, lambda k, v: ~v.eqNullSafe(F.try_element_at(before, k)))


def snippet(text: Column, limit: int = 200) -> Column:
    """null, the text, or its beginning with its length."""
    long = F.struct(F.substring(text, 1, limit).alias("preview"), F.lit(True).alias("truncated"), F.length(text).alias("length"))
    short = F.struct(text.alias("preview"), F.lit(False).alias("truncated"), F.length(text).alias("length"))
    return F.when(text.isNull(), F.lit(None)).when(F.length(text) > limit, long).otherwise(short)
