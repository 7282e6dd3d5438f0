"""op10_nearest_neighbours: the 20 nearest of every twentieth embedding. An approximate search has no SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.ann import nearest
from pageloom.llm.common import table

NEIGHBOURS = 20
EVERY = 20


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0, NEIGHBOURS)


QUERIES = {"op10_nearest_neighbours": op10_nearest_neighbours}
ORACLES: dict[str, str] = {}
