"""Streams: the audit feed appended to a table, and the running average of processing rates as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from pageloom.operators.audit import chain_status
from pageloom.operators.telemetry import LEAST_RATE, NEW, OLD, STARTUP_SHARE

RATES = "group_id bigint, seconds_per_page double, startup_seconds double, samples bigint"
STATE = "rate double, startup double, n bigint"


def follow(spark: SparkSession, path: str, schema: StructType, files: int | None = None) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to a table, exactly once, and stops."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


#: The status of an entry that comes after entries of later ids have been checked.
LATE = "late"


def append_checked(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends audit entries with their chain status; the first of a batch is held against the last of the batches before it.

    The state of the chain is one row, the last entry, which each batch leaves in a folder of its own beside the checkpoint for the next; no batch reads what
    is in the table. An entry whose id is not beyond that row's is `late`: it is kept, and the chain goes on without it. A batch that is tried again
    reads and writes the same folders, so that entries are there once.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark, state = batch.sparkSession, f"{checkpoint}/chain"
        last = spark.read.schema(batch.schema).parquet(f"{state}/{number - 1}").first() if number else None  # one row at most
        rows = batch if last is None else batch.where(F.col("id") > last.id)
        link = rows if last is None else rows.unionByName(spark.createDataFrame([last], batch.schema))
        checked = chain_status(link) if last is None else chain_status(link).where(F.col("id") > last.id)
        if last is not None:
            checked = checked.unionByName(batch.where(F.col("id") <= last.id).withColumn("chain_status", F.lit(LATE)))
        checked.write.mode("overwrite").parquet(f"{path}/batch={number}")
        link.orderBy(F.desc("id")).limit(1).write.mode("overwrite").parquet(f"{state}/{number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def _round(x: float, places: int) -> float:
    return round(x, places)


def running_rates(jobs: DataFrame, baseline_startup: float = 30.0) -> DataFrame:
    """jobs(group_id, at, pages, seconds): the averages of each group after every batch; jobs of a batch count in order of `at`."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rate, startup, n = state.get if state.exists else (0.0, 0.0, 0)
        for job in pd.concat(list(batches)).sort_values("at").itertuples():
            if job.pages <= 0 or job.seconds <= 0:
                continue
            begin = min(baseline_startup, job.seconds * STARTUP_SHARE)
            own = max(LEAST_RATE, (job.seconds - begin) / job.pages)
            rate = _round(own if rate <= 0 else OLD * rate + NEW * own, 4)
            startup = _round(begin if startup <= 0 else OLD * startup + NEW * begin, 2)
            n += 1
        state.update((rate, startup, n))
        yield pd.DataFrame({"group_id": [key[0]], "seconds_per_page": [rate], "startup_seconds": [startup], "samples": [n]})

    return jobs.groupBy("group_id").applyInPandasWithState(step, RATES, STATE, "update", GroupStateTimeout.NoTimeout)
