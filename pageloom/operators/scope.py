"""Who may see what, and which steps of a document's workflow are open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def own_documents(documents: DataFrame, user: str) -> DataFrame:
    """Documents without an uploader, or with this one."""
    return documents.where(F.col("uploaded_by").isNull() | (F.col("uploaded_by") == user))


def may_change(owner: Column, user: str, admin: bool) -> Column:
    return F.lit(admin) | F.coalesce(owner == "", F.lit(True)) | (owner == user)


def complete(state: Column) -> Column:
    return F.coalesce(state == "complete", F.lit(False))


def unlocked(state: Column, metadata_confirmed: Column, approved: Column) -> dict[str, Column]:
    """Which pages of the workflow are open."""
    done = complete(state)
    ready = done & (F.coalesce(metadata_confirmed, F.lit(False)) | approved)
    return {"review_open": done, "metadata_open": done, "approval_open": done, "preview_open": ready}


def approval_gate(open_items: Column, metadata_confirmed: Column, title: Column, publisher: Column) -> Column:
    """The first reason against approval, in order, or null."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(F.coalesce(open_items, F.lit(0)) > 0, "open_review_items")
        .when(~F.coalesce(metadata_confirmed, F.lit(False)), "metadata_not_confirmed")
        .when(blank(title) | blank(publisher), "title_or_publisher_missing")
    )


def find_documents(documents: DataFrame, text: str = "", state: str | None = None) -> DataFrame:
    """Documents by state (null counts as idle) and a piece of title, file name or uploader."""
    if state is not None:
        documents = documents.where(F.coalesce("state", F.lit("idle")) == state)
    if text.strip():
        haystack = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("file_name", F.lit("")), F.coalesce("uploaded_by", F.lit(""))))
        documents = documents.where(F.contains(haystack, F.lit(text.strip().lower())))
    return documents


def valid_id(document_id: Column) -> Column:
    return F.coalesce(document_id.rlike("^[A-Za-z0-9-]+$"), F.lit(False))


def page_in_range(page: Column, pages: Column) -> Column:
    return F.coalesce(page.between(F.lit(1), pages), F.lit(False))


def error_class(message: Column, rules: list[tuple[str, list[str]]] | None = None) -> Column:
    """The kind of a processing failure by the first group of keywords in its message."""
    out = F.lit("other")
    for kind, words in reversed(rules if rules is not None else ERRORS):
        found = F.lower(message)
        out = F.when(F.coalesce(F.greatest(*[F.contains(found, F.lit(w)) for w in words]), F.lit(False)), kind).otherwise(out)
    return out


#: Kinds of failure and the words that tell them, in order (fixed values).
ERRORS = [
    ("memory", ["out of memory", "bad_alloc", "paging file", "memoryerror"]),
    ("password", ["password", "encrypted", "decrypt"]),
    ("damaged", ["corrupt", "damaged", "truncated", "xref", "unexpected eof"]),
    ("network", ["connection", "network", "socket", "timed out", "timeout"]),
    ("unsupported", ["unsupported", "not a pdf", "file type"]),
]
