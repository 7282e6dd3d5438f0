"""Queries of order-dependent operators, which SQL doesn't express; tests hold them against fixed cases."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.operators import sequential
from pageloom.plans.inputs import table


def rect_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged boxes of the line items of each order."""
    k, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (k % 20).cast("double").alias("l"), (n * 12 + s % 9).cast("double").alias("t"), (k % 20 + 200).cast("double").alias("r"), (n * 12 + s % 9 + 10).cast("double").alias("b"))
    return sequential.per_page(boxes, sequential.merged_boxes)


def fuzzy_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of web pages as contents entries, matched to the paragraphs of the same page."""
    pages = table(spark, sf_dir, "pages")
    entries = pages.select(F.col("page_id").alias("doc_id"), F.lit(0).cast("bigint").alias("entry"), F.regexp_extract("html", r"<title>(.*?)</title>", 1).alias("title"), F.lit(1).alias("target"))
    body = F.regexp_replace(F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1), r"<[^>]*>", "\n")
    items = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.split(body, "\n+")).alias("order", "text"))
    items = items.select("doc_id", F.concat(F.lit("#"), F.col("order").cast("string")).alias("ref"), "order", F.lit(1).alias("page"), F.when(F.col("order") <= 1, "section_header").otherwise("text").alias("label"), "text")
    return sequential.match_entries(entries, items)


@F.arrow_udf(T.StringType())
def _linked(texts):
    return pa.array([sequential.linked_footnotes(t or "", {str(k): f"footnote-{k}" for k in range(1, 40)}) for t in texts.to_pylist()], pa.string())


def footnote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _linked("text").alias("html"))


QUERIES = {f.__name__: f for f in (rect_merge, fuzzy_title_match, footnote_links)}
ORACLES: dict[str, str] = {}
