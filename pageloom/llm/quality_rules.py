"""Quality rules by weak supervision.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts of vote patterns
estimates how often each rule votes right and how often documents are good, without labels; the
posterior probability of a good document then replaces the demand that every rule passes.

Only the table of vote patterns reaches the driver: its rows number at most 4 ** len(RULES), whatever
the corpus. It is counted over all documents.

Defined results: a null text counts as empty; an empty text, or one of white space, has n_words 0, so
base_failed is true and kept false; every rule abstains on it. Repeated rows are judged alike, ties at
the threshold are kept, an empty table gives an empty result, and other columns pass through untouched
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm import text_stats
from pageloom.llm.common import free_names, in_turn, settle

#: A vote; SILENT is that of a rule which a text is too short for, and is no evidence, while abstaining is.
GOOD, BAD, ABSTAIN, SILENT = 1, 0, 2, 3


STATISTICS = T.StructType([T.StructField(k, T.LongType()) for k in text_stats.FIELDS])


@F.arrow_udf(STATISTICS)
def text_statistics(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from in_turn(text_stats.stats_array)(texts)


def _share(top: Column, bottom: Column) -> Column:
    return top / F.greatest(bottom, F.lit(1))


def _bad_from(x: Column, bound: float) -> Column:
    """Bad from the bound on; below it the rule has nothing to say."""
    return F.when(x >= bound, BAD).otherwise(ABSTAIN)


def _above(x: Column, good: float, bad: float) -> Column:
    return F.when(x >= good, GOOD).when(x <= bad, BAD).otherwise(ABSTAIN)


def rules(stats: Column) -> dict[str, Column]:
    """Rule name -> vote, from the statistics of a text."""
    s = stats.getField
    n = s("n_words")
    shares = {
        "word_length": F.when(_share(s("word_chars"), n).between(2.0, 14.0), ABSTAIN).otherwise(BAD),
        "symbols": _bad_from(_share(s("n_symbols"), n), 0.1),
        "symbol_chars": _bad_from(_share(s("n_symbols"), s("word_chars")), 0.03),
        "repeat_lines": _bad_from(_share(s("n_dup_lines"), s("n_lines")), 0.2),
        "repeat_words": _bad_from(_share(s("n_repeat_words"), n), 0.15),
        "repeat_neighbours": _bad_from(_share(s("n_same_as_last"), n), 0.1),
        "capitals": _bad_from(_share(s("n_upper"), s("n_upper") + s("n_lower")), 0.2),
        "exclamations": _bad_from(_share(s("n_shouts"), n), 0.1),
        "function_words": _above(_share(s("n_function_words"), n), 0.08, 0.02),
        "sentences": _above(_share(s("n_stops"), n), 0.02, 0.004),
    }
    enough = {"sentences": 60, "function_words": 30}
    return {k: F.when(n >= enough.get(k, 10), v).otherwise(SILENT) for k, v in shares.items()}


RULES = ("word_length", "symbols", "symbol_chars", "repeat_lines", "repeat_words", "repeat_neighbours", "capitals", "exclamations", "function_words", "sentences")


@dataclass(frozen=True)
class LabelModel:
    """prior: share of good documents. votes[rule][class][vote]: probability of the vote in the class."""

    prior: float
    votes: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of a good document for each row of votes."""
        weight = np.zeros((len(self.votes), 4))  # SILENT weighs nothing
        weight[:, :3] = np.log(self.votes[:, GOOD] / self.votes[:, BAD])
        odds = math.log(self.prior / (1 - self.prior)) + weight[np.arange(len(weight)), patterns].sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


#: Votes expected before any are seen, by class: bad, good and abstaining; and how many such votes they weigh.
EXPECTED = {BAD: (0.35, 0.05, 0.6), GOOD: (0.02, 0.38, 0.6)}
WEIGHT = 2.0


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> LabelModel:
    """Fits the two-class model of independent votes to counts of patterns (rows of votes).

    The E step gives each pattern its posterior, the M step each rule its vote frequencies in either
    class, from which its accuracy follows. A rule may not turn round: its bad votes stay at least as
    frequent among bad documents as among good ones. With no patterns the expected votes stand.
    """
    n_rules = patterns.shape[1]
    votes = np.tile(np.array([EXPECTED[BAD], EXPECTED[GOOD]]), (n_rules, 1, 1))  # [rule, class, vote]
    prior, weights = 0.85, counts.astype(float)
    cast = np.stack([patterns == v for v in range(3)], axis=2).astype(float)  # [pattern, rule, vote]
    for _ in range(rounds if len(patterns) else 0):
        odds = math.log(prior / (1 - prior)) + np.einsum("prv,rv->p", cast, np.log(votes[:, GOOD] / votes[:, BAD]))
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        before = votes.copy()
        for c, w in ((GOOD, weights * good), (BAD, weights * (1 - good))):
            seen = np.einsum("p,prv->rv", w, cast) + WEIGHT * np.array(EXPECTED[c])
            votes[:, c] = seen / seen.sum(axis=1, keepdims=True)
        turned = votes[:, GOOD, BAD] > votes[:, BAD, BAD]
        votes[turned] = votes[turned].mean(axis=1, keepdims=True)
        prior = float(np.clip((weights @ good + 4) / (weights.sum() + 5), 0.02, 0.98))
        if np.abs(votes - before).max() < 1e-9:
            break
    return LabelModel(prior, votes)


def vote_pattern(stats: Column) -> Column:
    voted = rules(stats)
    return F.concat(*[voted[k].cast("string") for k in RULES])


def fit(patterns: DataFrame, pattern: str) -> LabelModel:
    """Counts the vote patterns of all rows and fits the model to them."""
    found = patterns.groupBy(pattern).count().collect()  # 4 ** len(RULES) rows at most
    votes = np.array([[int(v) for v in r[0]] for r in found], np.int64).reshape(len(found), len(RULES))
    return expectation_maximisation(votes, np.array([r[1] for r in found], np.int64))


def base_failed(stats: Column) -> Column:
    n = stats.getField("n_words")
    return (n < 10) | (100 * stats.getField("n_repeat_words") > 20 * n)


def judge(df: DataFrame, stats: Column, model: LabelModel, threshold: float = 0.5) -> dict[str, Column]:
    """Columns base_failed, posterior and kept of rows with statistics."""

    @F.arrow_udf(T.DoubleType())
    def posterior_of(patterns: pa.Array) -> pa.Array:
        cast = np.array([[ord(v) - 48 for v in p] for p in patterns.to_pylist()], np.int64).reshape(-1, len(RULES))
        return pa.array(model.posterior(cast), pa.float64())

    posterior = posterior_of(vote_pattern(stats))
    failed = base_failed(stats)
    return {"base_failed": failed, "posterior": posterior, "kept": ~failed & (posterior >= threshold)}


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that pass the base rules and have a posterior of the threshold or more, columns unchanged.

    The statistics of a text are worked out once: the rows are settled with them, the model is fitted to the table and judges it.
    """
    stats, pattern = free_names(docs, "stats_now", "votes_now")
    judged = settle(docs.withColumn(stats, text_statistics(F.col(text))), "rule_statistics")
    model = fit(judged.select(vote_pattern(F.col(stats)).alias(pattern)), pattern)
    return judged.where(judge(judged, F.col(stats), model, threshold)["kept"]).drop(stats)
