"""The corpus pipeline: documents go through the training-data operators one after another.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the
columns of documents, but for the last, which returns packed pieces. Nulls, empty texts, repeated rows,
empty tables and further columns are met as the operators' docstrings say: null and blank texts fail the
quality rules and go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import settle, table
from pageloom.llm.labels import fold
from pageloom.llm.minhash_dedup import keep_one
from pageloom.llm.mixing import in_order, mix
from pageloom.llm.op2_query import FOLDS
from pageloom.llm.op5_query import WEIGHTS
from pageloom.llm.op7_query import pack_documents
from pageloom.llm.quality_rules import keep_good
from pageloom.llm.toxicity import keep_clean


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the classifier learns from the labels of the remaining documents."""
    return keep_clean(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), FOLDS) != 0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their rows are put into the order of the mixture, file after file."""
    return in_order(mix(docs, WEIGHTS)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences; stretches of the mixture are packed apart, and sequences numbered in its order."""
    return pack_documents(docs, ordered=True)


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity), ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: Expectation-maximisation, boosting and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
