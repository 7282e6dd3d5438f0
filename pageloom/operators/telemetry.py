"""Job telemetry: estimates, progress and the running average of processing rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed factors of the estimate.
OCR_FACTOR, LEAST_SECONDS = 1.85, 10
OLD, NEW, LEAST_RATE, STARTUP_SHARE = 0.7, 0.3, 0.1, 0.4


def estimate_seconds(pages: Column, rate: Column, startup: Column, ocr: Column) -> Column:
    """Expected seconds of a job, rounded half to even, and never under ten."""
    work = F.greatest(F.lit(1), pages) * rate * F.when(ocr, OCR_FACTOR).otherwise(1.0)
    return F.greatest(F.lit(LEAST_SECONDS), F.bround(startup + work, 0)).cast("bigint")


def stage_progress(progress: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(progress, high))


def remaining_seconds(estimated: Column, elapsed: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(estimated - elapsed)).cast("bigint")


def remaining_text(seconds: Column) -> Column:
    """`h hr m min s sec` of whole seconds, leaving out leading parts that are zero."""
    total = F.greatest(F.lit(0), F.ceil(seconds)).cast("bigint")
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    part = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"))
    return (
        F.when(h > 0, F.concat_ws(" ", part(h, "hr"), part(m, "min"), part(s, "sec")))
        .when(m > 0, F.concat_ws(" ", part(m, "min"), part(s, "sec")))
        .otherwise(part(s, "sec"))
    )


def running_rates(jobs: DataFrame, group: str, order: str, baseline_startup: float = 30.0) -> DataFrame:
    """Seconds a page and start-up seconds of each group after its jobs in order, rounded at every step.

    Jobs without pages or duration don't count. The recurrence is a fold over the ordered jobs of a group.
    """
    runs = jobs.where((F.col("pages") > 0) & (F.col("seconds") > 0)).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "pages", "seconds"))).alias("runs"))

    def step(state: Column, run: Column) -> Column:
        startup = F.least(F.lit(baseline_startup), run["seconds"] * STARTUP_SHARE)
        rate = F.greatest(F.lit(LEAST_RATE), (run["seconds"] - startup) / run["pages"])
        blend = lambda old, new: F.when(old <= 0, new).otherwise(old * OLD + new * NEW)
        return F.struct(F.bround(blend(state["rate"], rate), 4).alias("rate"), F.bround(blend(state["startup"], startup), 2).alias("startup"), (state["n"] + 1).alias("n"))

    start = F.struct(F.lit(0.0).alias("rate"), F.lit(0.0).alias("startup"), F.lit(0).cast("bigint").alias("n"))
    return runs.select(group, F.aggregate("runs", start, step).alias("s")).select(group, F.col("s.rate").alias("seconds_per_page"), F.col("s.startup").alias("startup_seconds"), F.col("s.n").alias("samples"))
