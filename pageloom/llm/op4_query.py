"""op4_quality_rules: weakly supervised quality rules over all documents. EM has no SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import quality_rules as q
from pageloom.llm.common import settle, table

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics are written once as a narrow table; the model is fitted to it and judges it."""
    docs = table(spark, sf_dir, "documents")
    stats = F.col("stats")
    rows = settle(docs.select("doc_id", q.text_statistics("text").alias("stats")), "op4_stats")
    model = q.fit(rows.select(q.vote_pattern(stats).alias("votes")), "votes")
    return rows.withColumns(q.judge(rows, stats, model)).select("doc_id", *[f"stats.{c}" for c in BASE], "base_failed", "kept", "posterior")


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLES: dict[str, str] = {}
