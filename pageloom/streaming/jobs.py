"""Jobs that run in stages: progress after each, and cancelling between two."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


class Stopped(RuntimeError):
    """A job was cancelled before one of its stages."""


class Job:
    """Runs stages one after another under a Spark job group of its own.

    A stage is (message, function of the last stage's result). on_stage is called with number and message before each, and
    once more at the end. cancel() keeps the next stage from beginning, and with now=True also stops the Spark jobs of the one that runs.
    """

    def __init__(self, spark: SparkSession, name: str, on_stage: Callable[[int, str], None] = lambda step, message: None):
        self.spark, self.name, self.on_stage = spark, name, on_stage
        self._stopped = threading.Event()

    def cancel(self, now: bool = False) -> None:
        self._stopped.set()
        if now:
            self.spark.sparkContext.cancelJobGroup(self.name)

    @contextmanager
    def _group(self, message: str) -> Iterator[None]:
        context = self.spark.sparkContext
        context.setJobGroup(self.name, message, interruptOnCancel=False)
        try:
            yield
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
            context.setLocalProperty("spark.job.description", None)

    def run(self, stages: list[tuple[str, Callable[[Any], Any]]], start: Any = None) -> Any:
        result = start
        for step, (message, function) in enumerate(stages):
            if self._stopped.is_set():
                raise Stopped(f"{self.name} was stopped before: {message}")
            self.on_stage(step, message)
            with self._group(message):
                result = function(result)
        self.on_stage(len(stages), "done")
        return result

    def running(self) -> list[tuple[int, int, int]]:
        """(stage, tasks done, tasks in all) of the Spark stages that run now, for a poll of a job's progress."""
        tracker = self.spark.sparkContext.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup(self.name) if (info := tracker.getJobInfo(j)) for s in info.stageIds]
        found = [(s, tracker.getStageInfo(s)) for s in stages]
        return [(s, i.numCompletedTasks, i.numTasks) for s, i in found if i and i.numActiveTasks]


class ProgressListener(StreamingQueryListener):
    """Keeps the last progress of each streaming query, for whoever polls it: batch, rows and rows a second."""

    def __init__(self) -> None:
        self.last: dict[str, dict[str, float]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.last[str(event.id)] = {"batch": -1, "rows": 0, "rows_per_second": 0.0}

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        before = self.last.get(str(p.id), {"rows": 0})
        self.last[str(p.id)] = {"batch": p.batchId, "rows": before["rows"] + p.numInputRows, "rows_per_second": p.processedRowsPerSecond}

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.add(str(event.id))
