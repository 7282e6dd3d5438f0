"""Whole queries over the small tables against plain versions of what they have to return."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pageloom.llm import quality_rules, text_stats, toxicity
from pageloom.llm.labels import fold
from pageloom.llm.op2_query import op2_toxicity
from pageloom.llm.op4_query import op4_quality_rules
from pageloom.llm.op5_query import WEIGHTS, op5_mixing
from pageloom.llm.op6_query import op6_quality_classifier
from pageloom.llm.op7_query import op7_packing
from pageloom.llm.op9_query import op9_token_files

SF = "/root/testdata/sf0.001"
#: Large enough for several blocks of each source.
SEVERAL_BLOCKS = "/root/testdata/sf0.01"
#: Large enough for a share of held-out documents that says something.
LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def encoded(spark):
    """doc_id and ids of each document, by the tokenizers library alone."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [(r.doc_id, np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")) for r in rows]


def test_token_files_query(spark, encoded):
    got = sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in op9_token_files(spark, SF).collect())
    start, expected = 0, []
    for doc_id, ids in encoded:
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected


def test_packing_query(spark, encoded):
    rows = op7_packing(spark, SF).collect()
    expected = {(doc_id, at // 4096, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for doc_id, ids in encoded for at in range(0, len(ids), 4096)}
    assert len(rows) == len(expected) and {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows} == expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= 1.03 * -(-sum(r.length for r in rows) // 4096)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_of(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, by the plainest means."""
    words = words_of(text)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    held = Counter(grams)
    inside = {k + j for k, g in enumerate(grams) if held[g] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_quality_rules_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op4_quality_rules(spark, SF).collect()}
    assert len(got) == len(rows)
    stats = spark.createDataFrame([(r.doc_id, text_stats.stats_of(r.text)) for r in rows], quality_rules.T.StructType([quality_rules.T.StructField("doc_id", quality_rules.T.LongType()), quality_rules.T.StructField("stats", quality_rules.STATISTICS)]))
    patterns = {r[0]: r[1] for r in stats.select("doc_id", quality_rules.vote_pattern(F.col("stats"))).collect()}
    held = Counter(patterns.values())
    votes = np.array([[int(v) for v in p] for p in held], np.int64)
    model = quality_rules.expectation_maximisation(votes, np.array(list(held.values())))
    good = dict(zip(held, model.posterior(votes), strict=True))
    for r in rows:
        n, chars, symbols, lines, repeats = base_of(r.text)
        row = got[r.doc_id]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n, chars, symbols, lines, repeats)
        failed = n < 10 or 100 * repeats > 20 * n
        assert row.base_failed == failed and row.posterior == pytest.approx(good[patterns[r.doc_id]])
        assert row.kept == (not failed and good[patterns[r.doc_id]] >= 0.5)


def held_out(spark, query, label, folds, remainder):
    """AUC and accuracy of a classifier's query over the labelled documents that it didn't learn from."""
    rows = query(spark, LARGER)
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    assert rows.count() == docs.count()
    aside = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % folds == remainder
    met = rows.where(aside).join(spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", F.col(label).alias("y")), "doc_id").where("y is not null").collect()
    assert met and all(r.held_out and 0 <= r.score <= 1 for r in met)
    pos, neg = [r.score for r in met if r.y], [r.score for r in met if not r.y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg)), sum(r.predicted == r.y for r in met) / len(met)


def test_toxicity_on_documents_held_out(spark):
    area, right = held_out(spark, op2_toxicity, "toxic", 5, 0)
    assert area >= 0.97 and right >= 0.97


def test_quality_on_documents_held_out(spark):
    area, right = held_out(spark, op6_quality_classifier, "quality", 4, 2)
    assert area >= 0.98 and right >= 0.97


def test_mixing_query(spark):
    from tests.llm.test_methods import ideal_shares

    """At every slot each source is less than one block from the share that its target weight gives it, and far from equal shares."""
    rows = op5_mixing(spark, SEVERAL_BLOCKS).collect()
    docs = spark.read.parquet(f"{SEVERAL_BLOCKS}/documents.parquet")
    assert Counter(r.source for r in rows) == Counter(r.source for r in docs.select("source").collect()) and len({(r.slot, r.place) for r in rows}) == len(rows)
    source_of = {r.slot: r.source for r in rows}
    assert set(source_of) == set(range(len(source_of)))
    names = sorted(set(source_of.values()))
    no = np.array([names.index(source_of[t]) for t in range(len(source_of))])
    blocks, taken = np.bincount(no).tolist(), np.cumsum(no[:, None] == np.arange(len(names)), axis=0)
    given = [WEIGHTS.get(s, min(WEIGHTS.values())) for s in names]
    assert np.abs(taken - ideal_shares(blocks, given)).max() < 1 + 1e-6
    assert np.abs(taken - ideal_shares(blocks, [1.0] * len(names))).max() > 1.05


def test_pipeline(spark, encoded):
    """Each stage's decisions by plain means, the fitted models apart: the documents that stay, and their pieces."""
    from tests.llm.test_methods import brute_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    good = {r.doc_id for r in op4_quality_rules(spark, SF).where("kept").select("doc_id").collect()}
    kept = docs.where(F.col("doc_id").isin(*good))
    scorer = toxicity.fit(kept, spark.read.parquet(f"{SF}/labels.parquet"), fold(F.col("doc_id"), 5) != 0)
    clean = sorted(d for d in good if scorer.scores([text[d]])[0] < 0.5)
    component = brute_components([(d, text[d]) for d in clean])
    expected = {d for d in clean if component[d] == d}
    rows = corpus_pipeline.run(spark, SF).collect()
    ids = dict(encoded)
    pieces = {(d, at // 4096, at, len(ids[d][at : at + 4096]), zlib.crc32(ids[d][at : at + 4096].tobytes())) for d in expected for at in range(0, len(ids[d]), 4096)}
    assert len(rows) == len(pieces) and {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows} == pieces
