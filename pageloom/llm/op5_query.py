"""op5_mixing: a place for every document in a mixture of its sources. Deadline scheduling has no SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm.common import table
from pageloom.llm.mixing import mix

#: Target weights by source: the first eight sources are the better ones; all others weigh as little as the least here.
WEIGHTS: dict[str | None, float] = {"src0": 8, "src1": 4, "src2": 4, "src3": 4, "src4": 2, "src5": 2, "src6": 2, "src7": 1.5, "src8": 1}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, WEIGHTS).select("doc_id", "source", "source_block", "place", "slot", "phase")


QUERIES = {"op5_mixing": op5_mixing}
ORACLES: dict[str, str] = {}
