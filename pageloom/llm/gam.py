"""A quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after another and fits a tree of up to three leaves on that feature
alone to the gradient; all trees of a feature add up to one lookup table over its bins. Then pairs of
features whose joint cells explain most of what is left get tables of their own, by boosted trees that cut
first one and then the other feature. A score is the intercept plus one table entry a feature and pair.

Only a bounded sample (SAMPLE labelled documents) reaches the driver, as rows of numbers. All documents
are scored, whole.

Defined results: null and empty texts have zero features and get the score of such texts; repeated rows
get equal scores. Without a label of each kind the score is the share of good labels (1 where there are none).
Empty tables give empty results, and other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm import text_stats
from pageloom.llm.common import free_names, in_turn
from pageloom.llm.labels import labelled
from pageloom.llm.trees import RIDGE, binned, edges_of, sigmoid

SAMPLE = 30_000
BINS = 32
COARSE = 8
PAIRS = 6
FEATURES = ("length", "word_length", "symbols", "repeated_lines", "repeated_words", "same_as_last", "capitals", "digits", "exclamations", "sentence_marks", "distinct", "function_words", "ended_lines", "line_length", "top_word")


def features_of(stats: tuple[int, ...]) -> list[float]:
    s = dict(zip(text_stats.FIELDS, stats, strict=True))
    n, lines, cased = max(s["n_words"], 1), max(s["n_lines"], 1), max(s["n_upper"] + s["n_lower"], 1)
    return [
        float(np.log1p(s["n_words"])),
        s["word_chars"] / n,
        s["n_symbols"] / n,
        s["n_dup_lines"] / lines,
        s["n_repeat_words"] / n,
        s["n_same_as_last"] / n,
        s["n_upper"] / cased,
        s["n_digits"] / n,
        s["n_shouts"] / n,
        s["n_stops"] / n,
        s["n_distinct"] / n,
        s["n_function_words"] / n,
        s["n_ended_lines"] / lines,
        float(np.log1p(s["n_words"] / lines)),
        s["n_top_word"] / n,
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def text_features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from in_turn(lambda batch: pa.array([features_of(text_stats.stats_of(t.as_py())) for t in batch], pa.list_(pa.float64())))(texts)


@dataclass
class Additive:
    """tables[j]: contribution by bin of feature j. pairs: ((i, j), table over coarse bins)."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float
    tables: np.ndarray
    pairs: list[tuple[tuple[int, int], np.ndarray]] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        fine = binned(x, self.edges)
        out = self.intercept + self.tables[np.arange(len(self.edges)), fine].sum(1)
        for (i, j), table in self.pairs:
            out += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return out


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram; a cut at c keeps bins 0..c on the left."""
    if len(g) < 2:
        return 0.0, 0
    gs, hs = g.cumsum()[:-1], h.cumsum()[:-1]
    gain = gs**2 / (hs + RIDGE) + (g.sum() - gs) ** 2 / (h.sum() - hs + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(np.argmax(gain))
    return float(gain[at]), at


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + RIDGE))


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values over the bins of a tree of up to three leaves."""
    out = np.full(len(g), _leaf(g, h))
    gain, cut = _best_cut(g, h)
    if gain <= 0:
        return out
    parts = [slice(0, cut + 1), slice(cut + 1, None)]
    second = max(range(2), key=lambda k: _best_cut(g[parts[k]], h[parts[k]])[0])
    for k, part in enumerate(parts):
        out[part] = _leaf(g[part], h[part])
        if k == second and (inner := _best_cut(g[part], h[part]))[0] > 0:
            low = (part.start or 0) + inner[1] + 1
            for piece in (slice(part.start, low), slice(low, part.stop)):
                out[piece] = _leaf(g[piece], h[piece])
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values over the cells of a tree that cuts one feature, then the other on either side."""
    best, out = -1.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        gain, cut = _best_cut(a.sum(1), b.sum(1))
        table, total = np.zeros_like(a), gain
        for part in (slice(0, cut + 1), slice(cut + 1, None)):
            more, inner = _best_cut(a[part].sum(0), b[part].sum(0))
            total += more
            for piece in (slice(0, inner + 1), slice(inner + 1, None)):
                table[part, piece] = _leaf(a[part, piece], b[part, piece])
        if total > best:
            best, out = total, table.T if turned else table
    return out


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.15) -> Additive:
    edges = edges_of(x, BINS)
    coarse = [np.unique(e[np.linspace(0, len(e) - 1, min(COARSE - 1, len(e))).astype(int)]) if len(e) else e for e in edges]
    fine = binned(x, edges)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Additive(edges, coarse, float(np.log(mean / (1 - mean))), np.zeros((len(edges), BINS)))
    margin = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j, own in enumerate(edges):
            p = sigmoid(margin)
            n = len(own) + 1
            step = rate * shallow_tree(np.bincount(fine[:, j], y - p, n), np.bincount(fine[:, j], np.maximum(p * (1 - p), 1e-6), n))
            model.tables[j, :n] += step
            margin += step[fine[:, j]]
    cells = binned(x, coarse)
    sizes = [len(c) + 1 for c in coarse]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = cells[:, i] * sizes[j] + cells[:, j]
        p = sigmoid(margin)
        n = sizes[i] * sizes[j]
        return at, np.bincount(at, y - p, n).reshape(sizes[i], sizes[j]), np.bincount(at, np.maximum(p * (1 - p), 1e-6), n).reshape(sizes[i], sizes[j])

    def strength(i: int, j: int) -> float:
        _, g, h = grid(i, j)
        return float((g**2 / (h + RIDGE)).sum() - (g.sum(1) ** 2 / (h.sum(1) + RIDGE)).sum() - (g.sum(0) ** 2 / (h.sum(0) + RIDGE)).sum())

    ranked = sorted(((i, j) for i in range(len(edges)) for j in range(i) if min(sizes[i], sizes[j]) > 1), key=lambda p: (-strength(*p), p))
    model.pairs = [(p, np.zeros((sizes[p[0]], sizes[p[1]]))) for p in ranked[:PAIRS]]
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs:
            at, g, h = grid(i, j)
            step = rate * pair_tree(g, h)
            table += step
            margin += step.ravel()[at]
    return model


class Scorer:
    def __init__(self, model: Additive | None, base: float):
        self.model, self.base = model, base

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.base) if self.model is None else sigmoid(self.model.margins(x))


def fit(docs: DataFrame, features: str, labels: DataFrame, learn: Column, limit: int = SAMPLE) -> Scorer:
    """Fits to docs(doc_id, features) whose labels(doc_id, quality) `learn` allows."""
    (found,) = free_names(docs.select("doc_id"), "features")
    rows = labelled(docs.select("doc_id", F.col(features).alias(found)), labels, "quality", learn, limit).select(found, "label").toArrow()
    x = rows.column(found).combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if rows.num_rows else np.zeros((0, len(FEATURES)))
    y = (rows.column("label").to_numpy() > 0).astype(float)
    if len(set(y)) < 2:
        return Scorer(None, float(y.mean()) if len(y) else 1.0)
    order = np.lexsort((*x.T, y))  # rows come in any order; the fit doesn't depend on it
    return Scorer(fit_additive(x[order], y[order]), float(y.mean()))


def score_column(scorer: Scorer, features: Column) -> Column:
    @F.arrow_udf(T.DoubleType())
    def score(column: pa.Array) -> pa.Array:
        return pa.array(scorer.scores(column.flatten().to_numpy().reshape(-1, len(FEATURES))), pa.float64())

    return score(features)
