"""op6_quality_classifier: a quality score for every document. A fitted classifier has no SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import gam
from pageloom.llm.common import settle, table
from pageloom.llm.labels import fold

FOLDS, HELD_OUT, GOOD = 4, 2, 0.7


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features are written once as a narrow table, which the fit and the scores read."""
    rows = settle(table(spark, sf_dir, "documents").select("doc_id", gam.text_features("text").alias("features")), "quality_features")
    scorer = gam.fit(rows, "features", table(spark, sf_dir, "labels"), fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    scored = rows.withColumn("score", gam.score_column(scorer, F.col("features")))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLES: dict[str, str] = {}
