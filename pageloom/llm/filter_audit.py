"""Filter interaction audit: what each of several filters removes in every order that they could be applied in.

Each document's failures are replayed as they stand: they are crossed with the broadcast table of all orders (k! rows for k filters, 120 for
five), the first failure in each order is computed, the steps are exploded, and conditional sums are aggregated by part, order
and step, combined in each task before a shuffle of at most a row for each of them.

Defined results: a null text is an empty one, and a null part the empty string. Repeated rows are counted each. A row without id is a
document that no smaller id precedes; a label without id belongs to none; if labels contradict each other, a document has both. Documents
need not have labels. Every part that a document has gets all orders and steps, zeros included; an empty table gives an empty result.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.llm.common import settle

WORD_GAPS = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text: few words, few distinct words, many capitals, odd symbols."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, WORD_GAPS), "")
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals.cast("long") > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def with_repeats(flagged: DataFrame, doc: str, digest: str, name: str) -> DataFrame:
    """flagged with a column for whether a smaller id has the same digest. Only digests with several ids are joined, one row each.

    These are settled, so that the join meets them as a shuffle of its own and adaptive execution can split a digest that many rows share.
    """
    firsts = flagged.groupBy(F.col(digest).alias("first_digest")).agg(F.min(doc).alias("first_id"), F.max(doc).alias("last_id")).where("first_id < last_id").drop("last_id")
    firsts = settle(firsts, "audit_firsts")
    met = flagged.join(firsts, F.col(digest) == F.col("first_digest"), "left")
    return met.withColumn(name, F.coalesce(F.col(doc) > F.col("first_id"), F.lit(False))).drop("first_digest", "first_id")


def with_labels(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """flagged with good and toxic, by doc_id."""
    marks = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    met = flagged.join(marks, F.col("doc_id") == F.col("label_id"), "left").drop("label_id")
    return met.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def replay(flagged: DataFrame, filters: str, marks: list[str]) -> DataFrame:
    """The counts of each part, order and step.

    flagged has part, a boolean column for each letter of filters (whether the document fails it) and the boolean columns
    marks, of which <mark>_lost are counted.
    """
    spark, bit = flagged.sparkSession, {c: 1 << k for k, c in enumerate(filters)}
    orders = spark.createDataFrame([("".join(p), [bit[c] for c in p]) for p in permutations(filters)], "filter_order string, bits array<int>")
    failed = sum((F.col(c).cast("int") * F.lit(bit[c]) for c in filters), F.lit(0))
    crossed = flagged.select("part", failed.alias("failed"), *marks).crossJoin(F.broadcast(orders))
    at = lambda k: F.col("failed").bitwiseAND(F.element_at("bits", k)) != 0
    first = F.coalesce(*[F.when(at(k), F.lit(k)) for k in range(1, len(filters) + 1)], F.lit(len(filters) + 1))
    steps = crossed.withColumn("first", first).withColumn("step", F.explode(F.array(*map(F.lit, range(1, len(filters) + 1)))))
    own, gone = F.element_at("bits", F.col("step")), F.col("first") == F.col("step")
    count = lambda condition: F.sum(F.when(condition, 1).otherwise(0))
    counted = steps.groupBy("part", "filter_order", "step").agg(
        count(F.col("first") > F.col("step")).alias("kept"),
        count(gone).alias("removed"),
        count((F.col("first") < F.col("step")) & (F.col("failed").bitwiseAND(own) != 0)).alias("redundant"),
        count(F.col("failed") == own).alias("unique_fails"),
        *[count(gone & F.col(m)).alias(f"{m}_lost") for m in marks],
    )
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Filters A to D by text_failures and E by identical texts, over documents (doc_id, text, lang), in all their orders."""
    text = F.coalesce("text", F.lit(""))
    part = F.coalesce("lang", F.lit("")).alias("part")
    looked = docs.select("doc_id", part, F.unhex(F.sha2(text, 256)).alias("digest"), *[v.alias(k) for k, v in text_failures(F.col("text")).items()])
    settled = settle(looked, "audit_flags")
    return replay(with_labels(with_repeats(settled, "doc_id", "digest", "E"), labels), "ABCDE", ["good", "toxic"])
