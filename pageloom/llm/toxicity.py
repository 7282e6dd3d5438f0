"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a text are densities of lexicon words, how near they stand to the second person, and the rates of
capitals, exclamations, punctuation and disguised words. The lexicon is a short public list and what the
labelled sample adds: words and word beginnings whose presence goes with the label far beyond chance.
Each half of the sample gets its training features from the lexicon of the other half, so that the trees
don't learn to trust words that only their own texts made notable. A quarter of the sample is kept from
the trees and fits the calibration.

Only the bounded sample (SAMPLE labelled documents) and tables of bounded size reach the driver: LEXICON
terms and a row of features for each sampled document. All documents are scored, whole, in one pass.

Defined results: null and empty texts have features of zero and get the score of such texts; repeated
rows get equal scores. Without a label of each kind the score is the share of toxic labels (0 where there are
none), the same for every text. Empty tables give empty results, and other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.common import free_names, give_back, settle
from pageloom.llm.labels import Isotonic, labelled
from pageloom.llm.trees import Boosted, fit_boosted

SAMPLE = 20_000
LEXICON = 2_000
#: A term counts for the lexicon from this likelihood ratio and log odds on.
NOTABLE, ODDS = 30.0, 1.5
BEGINNINGS = (3, 4, 5, 6, 7)
NEAR = 5
#: Texts that are Python strings at one time.
SLICE = 512
REMEMBERED = 150_000
#: Insults of English (a fixed list).
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown fool imbecile jerk ugly hate shut kill".encode().split())
#: Second-person words of English, French, German and Spanish (fixed values).
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti tus usted ustedes vosotros".encode().split())
#: Characters that stand for letters in disguised words (fixed values).
DISGUISES = bytes.maketrans(b"013457@$", b"oieastas")
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
FEATURES = ("weight_density", "weight", "hit_density", "hits", "insult_density", "insults", "near_density", "near_share", "second_person", "capitals", "exclamations", "punctuation", "disguised", "length", "heaviest", "distinct_hits")


def core_of(word: bytes) -> tuple[bytes, bool]:
    """The lower-cased word without marks and disguises, and whether there was a disguise to remove."""
    core = word.strip(MARKS)
    if core.isalpha() or not core or not core.isascii():
        return core, False
    plain = re.sub(rb"(.)\1{2,}", rb"\1", core.translate(DISGUISES).translate(None, MARKS))
    return (plain, plain != core) if plain.isalpha() else (core, False)


def terms_of(core: bytes) -> list[bytes]:
    """The word itself and its beginnings, marked with an asterisk."""
    return [core, *(core[:k] + b"*" for k in BEGINNINGS if len(core) > k)]


class Lexicon(dict):
    """Maps a raw lower-case word to the number of its kind; kinds holds weight, insult, disguised, second person."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights
        self.kinds: list[tuple[float, bool, bool, bool]] = [(0.0, False, False, False)]
        self.numbers = {self.kinds[0]: 0}

    def __missing__(self, word: bytes) -> int:
        core, disguised = core_of(word)
        weight = max((self.weights.get(t, 0.0) for t in terms_of(core)), default=0.0) if core else 0.0
        insult = core in INSULTS
        kind = (weight, insult, disguised and (insult or weight > 0), core in SECOND_PERSON)
        if kind not in self.numbers:
            self.numbers[kind] = len(self.kinds)
            self.kinds.append(kind)
        self[word] = self.numbers[kind]
        return self.numbers[kind]

    def features(self, text: str | None) -> list[float]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.lower().split()
        n = len(words)
        if not n:
            return [0.0] * len(FEATURES)
        if len(self) > REMEMBERED:
            self.clear()
        kinds = np.fromiter(map(self.__getitem__, words), np.int32, n)
        weight, insult, disguised, person = (np.array(c, float)[kinds] for c in zip(*self.kinds, strict=True))
        hits = np.flatnonzero((weight > 0) | (insult > 0))
        persons = np.flatnonzero(person)
        near = 0
        if len(hits) and len(persons):
            near = int((np.searchsorted(persons, hits + NEAR, "right") > np.searchsorted(persons, hits - NEAR)).sum())
        upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        marks = len(raw) - len(raw.translate(None, MARKS))
        shouts = raw.count(b"!")
        total, n_hits, n_insults = float(weight.sum()), len(hits), int(insult.sum())
        return [
            total / n,
            np.log1p(total),
            n_hits / n,
            np.log1p(n_hits),
            n_insults / n,
            np.log1p(n_insults),
            near / n,
            near / max(n_hits, 1),
            len(persons) / n,
            upper / len(raw),
            shouts / n,
            marks / len(raw),
            float(disguised.sum()) / n,
            np.log1p(n),
            float(weight.max()),
            np.log1p(len({words[k] for k in hits.tolist()})),
        ]


def count_terms(sample: DataFrame) -> DataFrame:
    """term and, for each half and label, in how many of the documents it occurs."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Counter() for _ in range(4)]

        def flush() -> pa.RecordBatch:
            terms = list(set().union(*found))
            columns = [pa.array(terms, pa.binary()), *(pa.array([c[t] for t in terms], pa.int64()) for c in found)]
            for c in found:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["term", "c0", "c1", "c2", "c3"])

        for batch in batches:
            for text, label, half in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                cores = {core_of(w)[0] for w in set((text.as_py() or "").encode("utf-8", "surrogatepass").lower().split())}
                found[2 * half + (label > 0)].update({t for c in cores if c for t in terms_of(c)})
                if sum(map(len, found)) > 150_000:
                    yield flush()
        yield flush()
        give_back()

    rows = sample.select("text", "label", "half").mapInArrow(counts, "term binary, c0 bigint, c1 bigint, c2 bigint, c3 bigint")
    return rows.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("c0", "c1", "c2", "c3")])


def weights(counts: np.ndarray, terms: list[bytes], sizes: np.ndarray) -> dict[bytes, float]:
    """Log odds of the notable terms. counts: of documents without and with the label; sizes: of either kind."""
    if not len(terms) or not sizes.min():
        return {}
    neg, pos = counts.T.astype(float)
    n_neg, n_pos = sizes
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    share = np.maximum(pos + neg, 1e-9) / (n_pos + n_neg)
    ratio = 2 * (pos * np.log(np.maximum(pos, 1e-9) / (n_pos * share)) + neg * np.log(np.maximum(neg, 1e-9) / (n_neg * share)))
    good = (odds >= ODDS) & (ratio >= NOTABLE)
    return {terms[k]: float(odds[k]) for k in np.flatnonzero(good)}


class Scorer:
    """Scores texts; holds the lexicon, the trees and the calibration."""

    def __init__(self, lexicon: dict[bytes, float], trees: Boosted | None, calibration: Isotonic | None, base: float):
        self.weights, self.trees, self.calibration, self.base = lexicon, trees, calibration, base
        self.lexicon: Lexicon | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lexicon": None}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.base)
        self.lexicon = self.lexicon if self.lexicon is not None else Lexicon(self.weights)
        return self.calibration(self.trees.margins(np.array([self.lexicon.features(t) for t in texts])))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, limit: int = SAMPLE) -> Scorer:
    """Fits to docs(doc_id, text) whose labels(doc_id, toxic) `learn` allows."""
    sample = labelled(docs.select("doc_id", "text"), labels, "toxic", learn, limit)
    split = F.pmod(F.xxhash64("doc_id", F.lit("split")), F.lit(8))
    sample = settle(sample.select("text", "label", (split % 2).cast("int").alias("half"), (split >= 6).alias("calibrates")), "toxic_sample")
    sizes = np.zeros((2, 2))
    for half, label, n in sample.groupBy("half", (F.col("label") > 0).cast("int")).count().collect():
        sizes[half, label] = n
    base = float(sizes[:, 1].sum() / max(sizes.sum(), 1))
    if not sizes.sum(0).min():
        return Scorer({}, None, None, base)
    score = F.col("c1") + F.col("c3")
    candidates = count_terms(sample).where(score >= 3).orderBy((score / (F.col("c0") + F.col("c2") + 1)).desc(), score.desc(), "term").limit(20 * LEXICON).collect()
    terms = [bytes(r["term"]) for r in candidates]
    counts = np.array([[r[c] for c in ("c0", "c1", "c2", "c3")] for r in candidates], float).reshape(len(terms), 4)
    whole = weights(counts[:, :2] + counts[:, 2:], terms, sizes.sum(0))
    whole = dict(sorted(whole.items(), key=lambda t: (-t[1], t[0]))[:LEXICON])
    other = [weights(counts[:, 2:], terms, sizes[1]), weights(counts[:, :2], terms, sizes[0])]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [Lexicon(w) for w in other]
        for batch in batches:
            text, label, half, calibrates = (batch.column(k) for k in range(4))
            rows = [lexicons[h].features(t.as_py()) for t, h in zip(text, half.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), label, calibrates], names=["x", "label", "calibrates"])

    rows = sample.select("text", "label", "half", "calibrates").mapInArrow(features, "x array<double>, label int, calibrates boolean").toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    y = (rows.column("label").to_numpy() > 0).astype(float)
    aside = rows.column("calibrates").to_numpy()
    order = np.lexsort((*x.T, y))  # rows come in any order; the fit doesn't depend on it
    x, y, aside = x[order], y[order], aside[order]
    if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        aside = np.zeros(len(y), bool)
        trees = fit_boosted(x, y)
        return Scorer(whole, trees, Isotonic(trees.margins(x), y), base)
    trees = fit_boosted(x[~aside], y[~aside])
    return Scorer(whole, trees, Isotonic(trees.margins(x[aside]), y[aside]), base)


def score_column(scorer: Scorer, text: Column) -> Column:
    @F.arrow_udf(T.DoubleType())
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            parts = [scorer.scores(batch.slice(at, SLICE).to_pylist()) for at in range(0, len(batch), SLICE)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())
        scorer.lexicon = None
        give_back()

    return score(text)


def keep_clean(docs: DataFrame, labels: DataFrame, learn: Column, limit: int = SAMPLE) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that score below 0.5, columns unchanged."""
    scorer = fit(docs, labels, learn, limit)
    (score,) = free_names(docs, "score_now")
    return docs.withColumn(score, score_column(scorer, F.col("text"))).where(F.col(score) < 0.5).drop(score)
