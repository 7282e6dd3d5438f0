"""Labelled samples of bounded size for fitting classifiers, and score calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo the number of folds; null for a null doc_id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int) -> DataFrame:
    """docs with a column `label` of 0 or 1, for at most `limit` labelled doc_ids: those of smallest hash.

    labels counts where it is not null and `learn` holds; of contradictory rows the larger label stands.
    The broadcast side is that sample, so its size is bounded by `limit`.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn)
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.join(F.broadcast(sample), "doc_id")


class Isotonic:
    """Monotone calibration by pooling adjacent violators, linear between the pooled blocks."""

    def __init__(self, scores: np.ndarray, labels: np.ndarray):
        order = np.argsort(scores, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, weight, sum of scores
        for s, y in zip(scores[order].tolist(), labels[order].tolist(), strict=True):
            blocks.append([y, 1.0, s])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                y1, w1, s1 = blocks.pop()
                blocks[-1] = [blocks[-1][0] + y1, blocks[-1][1] + w1, blocks[-1][2] + s1]
        self.x = np.array([s / w for _, w, s in blocks] or [0.0])
        self.y = np.array([(y + 0.02) / (w + 0.04) for y, w, _ in blocks] or [0.5])
        self.y = np.maximum.accumulate(self.y)

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; a slight slope keeps the order of scores inside blocks and beyond the ends."""
        slope = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
        return np.clip(0.999 * np.interp(scores, self.x, self.y) + 0.001 * slope, 0.0, 1.0)
