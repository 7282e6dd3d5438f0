"""op2_toxicity: a score for every document. A fitted classifier has no SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import toxicity
from pageloom.llm.common import table
from pageloom.llm.labels import fold

FOLDS = 5


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), FOLDS) != 0)
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    scored = docs.withColumn("score", toxicity.score_column(scorer, F.col("text")))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
