"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pageloom.llm import ann, gam, licenses, minhash_dedup, mixing, packing, quality_rules, token_files, toxicity, url_filter
from pageloom.llm.common import settle
from pageloom.llm.op7_query import END_ID, TOKENIZER, pack_documents

GOOD = "The house of the old man is on the hill and it was built for the king. " * 4
BAD = "spam!! SPAM!! " * 60
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark):
    long_text = " ".join(f"word{k % 977} of the" for k in range(30_000))
    rows = [(1, GOOD, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "en", "b", 3), (None, GOOD + "x", "en", None, 1), (5, GOOD, "en", "a", 1), (5, GOOD, "en", "a", 1), (6, BAD, "en", "b", 1), (7, long_text, "en", "b", 1), (8, "one two", "en", "b", 1)]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    got = {(r.doc_id, r.n_shingles): r for r in minhash_dedup.find_components(odd_docs(spark)).collect()}
    assert len(got) == 9  # the repeated row counts once here
    assert got[(3, 0)].component_id == 3 and got[(3, 0)].kept and got[(2, 0)].kept and got[(4, 0)].kept
    ones = [r for k, r in got.items() if k[0] in (1, 5)]
    assert {r.component_id for r in ones} == {1} and got[(8, 1)].n_shingles == 1
    assert [r.component_id for k, r in got.items() if k[0] is None] == [1]
    assert minhash_dedup.find_components(empty_docs(spark)).count() == 0


def test_components_of_documents_without_ids(spark):
    docs = spark.createDataFrame([(None, GOOD), (None, GOOD), (None, "")], "doc_id long, text string")
    assert all(r.kept and r.component_id is None for r in minhash_dedup.find_components(docs).collect())
    assert minhash_dedup.keep_one(docs).count() == 2


def test_components_of_shared_and_missing_ids(spark):
    texts = {c: " ".join(f"{c}{k}" for k in range(80)) for c in "abcdef"}
    docs = [(None, texts["a"]), (None, texts["a"] + " x"), (None, texts["b"]), (7, texts["b"] + " x"), (None, ""), (None, texts["e"])]
    docs += [(5, texts["c"]), (5, texts["d"]), (3, texts["c"] + " x"), (6, texts["d"] + " x"), (8, texts["f"]), (8, texts["f"] + " x y")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in minhash_dedup.find_components(frame).collect())
    assert got == [(0, 0, 0), (0, 76, 0), (0, 76, 0), (0, 76, 7), (0, 77, 0), (3, 77, 3), (5, 76, 3), (5, 76, 5), (6, 77, 5), (7, 77, 7), (8, 76, 8), (8, 78, 8)]
    kept = [(r.doc_id, r.text) for r in minhash_dedup.keep_one(frame).collect()]
    assert len(kept) == 7 and {(7, texts["b"] + " x"), (None, ""), (None, texts["e"]), (3, texts["c"] + " x"), (5, texts["d"])} < set(kept)
    assert sum(i is None and t.startswith("a0") for i, t in kept) == 1 and sum(i == 8 for i, t in kept) == 1


def test_quality_rules(spark):
    docs = odd_docs(spark).withColumn("stats_now", F.lit(1)).withColumn("votes_now", F.lit("x"))
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect() if r.doc_id in (2, 3, 4, 6, 8)) == []
    assert quality_rules.keep_good(empty_docs(spark)).count() == 0


def test_toxicity_without_labels(spark):
    docs = odd_docs(spark).withColumn("score_now", F.lit(0))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    kept = toxicity.keep_clean(docs, none, F.lit(True))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    some = spark.createDataFrame([(1, 0), (6, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    assert toxicity.keep_clean(empty_docs(spark), some, F.lit(True)).count() == 0
    scorer = toxicity.fit(docs, some, F.lit(True))
    scores = [r[0] for r in docs.select(toxicity.score_column(scorer, F.col("text"))).collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[1] == scores[2] == scores[3] and scores[5] == scores[6]


def test_toxicity_learns_words(spark):
    rows = [(k, ("you are a zumbler " if k % 4 == 0 else "a plain sentence ") + f"number {k} of the list") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)], "doc_id long, toxic int")
    scorer = toxicity.fit(docs, labels, F.lit(True))
    got = docs.where("doc_id >= 300").withColumn("s", toxicity.score_column(scorer, F.col("text"))).collect()
    assert all((r.s >= 0.5) == (r.doc_id % 4 == 0) for r in got)
    assert toxicity.core_of(b"id10t!") == (b"idiot", True) and toxicity.core_of(b"m.o.r.o.n") == (b"moron", True)


def test_quality_classifier(spark):
    docs = odd_docs(spark).select("doc_id", gam.text_features("text").alias("features"))
    one = gam.fit(docs, "features", spark.createDataFrame([(1, 1)], "doc_id long, quality int"), F.lit(True))
    assert {r[0] for r in docs.select(gam.score_column(one, F.col("features"))).collect()} == {1.0}
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only the interaction tells
    model = gam.fit_additive(np.hstack([x, np.zeros((2000, len(gam.FEATURES) - 3))]), y, 20, 60)
    assert (((model.margins(np.hstack([x, np.zeros((2000, len(gam.FEATURES) - 3))])) > 0) == (y > 0.5)).mean()) > 0.97


def test_packing(spark):
    pieces = pack_documents(odd_docs(spark).withColumn("sequence_id", F.lit(0)))
    rows = pieces.collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8, None}
    assert [r.length for r in rows if r.doc_id in (2, 3, 4)] == [1, 1, 1] and max(r.length for r in rows) <= 4096
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert pack_documents(empty_docs(spark)).count() == 0


def test_packing_in_rounds(spark):
    pieces = settle(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.col("id") * 37 % 90 + 5).alias("length"), F.lit(0).cast("long").alias("ids_crc32")), "pieces")
    total = pieces.agg(F.sum("length")).first()[0]
    rows = packing.pack(pieces, 100, shard_size=500).collect()
    assert len(rows) == 3000 and len({r.sequence_id for r in rows}) <= 1.03 * -(-total // 100)


def test_packing_in_order(spark, tmp_path, monkeypatch):
    """Documents in files are packed in stretches of their order; others can't be placed."""
    monkeypatch.setattr(packing, "RANGE", 300)
    docs = spark.range(0, 2400, 1, 3).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("the old house "), (F.col("id") * 7 % 400).cast("int")), F.col("id").cast("string")).alias("text"))
    assert packing.in_file_order(docs.where("doc_id < 5").select((F.col("doc_id") + 0).alias("doc_id"), "text").union(docs.limit(1))) is None
    docs.write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    places = {r.doc_id: r.place for r in packing.in_file_order(stored).collect()}
    assert sorted(places.values()) == list(range(2400)) and all(places[k] == k for k in range(0, 2400, 97))
    rows = pack_documents(stored, ordered=True).collect()
    assert {r.doc_id for r in rows} == set(range(2400)) and "place" not in rows[0]
    spans, total = {}, 0
    for r in rows:
        spans.setdefault(r.sequence_id, []).append(places[r.doc_id])
        total += r.length
    assert len(spans) <= 1.04 * -(-total // 4096)
    firsts = [min(v) // 300 for _, v in sorted(spans.items()) if max(v) // 300 == min(v) // 300]
    assert len(firsts) > 0.7 * len(spans) and firsts == sorted(firsts)


def test_token_files(spark, tmp_path):
    import public_tokenizers

    token_files.write_token_files(odd_docs(spark), str(tmp_path / "t"), public_tokenizers.path(TOKENIZER), END_ID)
    rows = token_files.read_token_files(spark, str(tmp_path / "t"), keep_ids=True).orderBy("start").collect()
    assert len(rows) == 10 and rows[0].doc_id is None and [r.doc_id for r in rows[1:]] == [1, 2, 3, 4, 5, 5, 6, 7, 8]
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == r.n_tokens and r.ids[-1] == END_ID
        at += r.n_tokens
    token_files.write_token_files(empty_docs(spark), str(tmp_path / "e"), public_tokenizers.path(TOKENIZER), END_ID)
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_mixing(spark):
    docs = odd_docs(spark).withColumn("s", F.lit(1)).withColumn("slot", F.lit(-1)).withColumn("hashed", F.lit(2))
    rows = mixing.mix(docs, {"a": 2.0, "b": 1.0}, block=2).collect()
    assert len(rows) == 10 and {r.slot for r in rows} == set(range(max(r.slot for r in rows) + 1))
    assert all(r.s == 1 and r.hashed == 2 for r in rows)
    assert mixing.mix(empty_docs(spark)).count() == 0
    weights = {"a": float("inf"), "b": float("nan"), None: 3.0, "c": 0.5}
    no = mixing.plan([2, 3, 3], [weights["a"], 0.5, 3.0]).column("no").to_pylist()
    assert no[:2] == [0, 0] and sorted(no[2:]) == [1, 1, 1, 2, 2, 2] and no[2:5].count(2) >= 2
    first = mixing.mix(docs, weights, block=2).where("slot < 2").collect()
    assert {r.source for r in first} == {"a"}


def test_url_filter(spark):
    rules = spark.createDataFrame([("block", "COM", "/en/"), ("allow", "example.com", "/en/7"), ("block", "x.org", "")], "verdict string, host string, path string")
    urls = ["http://a.example.com/en/78", "http://EXAMPLE.com/en/8?q", "http://notcom/en/", "http://x.org", "http://yx.org/", None, "no scheme com/en/", "a://b.com#x/en/", "http://a.com/en/\nx", "://.com/en/"]
    pages = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls)] + [(0, urls[0], "old")], "page_id long, url string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got[0] == ("example.com/en/7", "allow") and got[1] == ("com/en/", "block") and got[3] == ("x.org", "block")
    assert [got[k] for k in (2, 4, 5, 6, 7)] == [(None, "allow")] * 5 and got[8] == ("com/en/", "block") and got[9] == ("com/en/", "block")
    assert url_filter.judge_urls(pages, rules).count() == len(urls) + 1
    assert url_filter.judge_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == len(urls) + 1
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_nearest(spark):
    rows = [(k, [float(k % 3), 1.0]) for k in range(30)] + [(90, None), (91, []), (92, [0.0, 0.0]), (93, [float("nan"), 1.0]), (94, [1.0]), (95, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 5 == 0, 4).collect()
    assert {r.query_id for r in got} == {0, 5, 10, 15, 20, 25}
    best = [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: (r.query_id, r["rank"])) if r.query_id == 5]
    assert best == [(1, 2, 5.0), (2, 8, 5.0), (3, 11, 5.0), (4, 14, 5.0)]
    huge = [(k, [1e-200 * (k + 1), 1e-210]) for k in range(100)] + [(200, [1e200, 1.0]), (210, [1e308, -1.0])]
    found = ann.nearest(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20).collect()
    assert len(found) == 6 * 20 and {r.query_id for r in found} == {0, 20, 40, 60, 80, 200}
    assert [r.vec_id for r in found if r["rank"] == 1] == [210] * 6 and {r.score for r in found if r.query_id == 200 and r["rank"] == 1} == {float("inf")}
    few = ann.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>"), F.lit(True), 20).collect()
    assert len(few) == 6
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True), 3).count() == 0


def test_license_scan(spark):
    variant = "Copyright (c) 2020 Somebody\n\n" + licenses.MIT.upper().replace(",", " ;").replace("SUBLICENSE", "sub-licence")
    docs = spark.createDataFrame([(1, variant), (2, "Text.\n  released under the MIT licence!\nMore."), (3, None), (4, "..."), (2, "other"), (None, "Released under the MIT License."), (None, "just a poem")], "doc_id long, text string").withColumn("license", F.lit("old"))
    got = [(r.doc_id, r.license, r.notices, r.digest is None) for r in licenses.scan(docs).orderBy("doc_id", "text").collect()]
    assert got == [(None, "MIT", "MIT", False), (None, None, None, False), (1, "MIT", None, False), (2, None, "MIT", False), (2, None, None, False), (3, None, None, True), (4, None, None, True)]
    clashing = docs.withColumns({c: F.lit(1) for c in ("own", "raw", "mine", "form", "lower", "line")})
    assert licenses.scan(clashing).where("own = 1 and raw = 1 and mine = 1 and notices = 'MIT'").count() == 2
    assert licenses.scan(docs.limit(0)).count() == 0
    own = spark.createDataFrame([(1, "A licence of our own.")], "doc_id long, text string")
    digest = licenses.with_digest(own, "text").first().digest
    assert [r.license for r in licenses.scan(own, digests=[("Own-1.0", digest)]).collect()] == ["Own-1.0"]


@pytest.mark.parametrize("make", [odd_docs, empty_docs])
def test_pipeline_stages(spark, tmp_path, make):
    docs = make(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = settle(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == docs.columns, name
        docs = out
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[:3] == ["doc_id", "piece", "start"]


def test_very_long_texts_of_scans_and_sources(spark):
    """A text of 3 MB with a notice in its midst, a source name of 1 MB, repeated rows and ties."""
    long_text = "word and more words here\n" * 60_000 + "Released under the MIT License.\n" + "x" * 1_500_000
    docs = spark.createDataFrame([(1, long_text), (1, long_text), (2, "MIT")], "doc_id long, text string")
    assert [r.notices for r in licenses.scan(docs).orderBy("doc_id").collect()] == ["MIT", "MIT", None]
    sources = spark.createDataFrame([(1, "s" * 1_000_000), (1, "s" * 1_000_000), (1, None), (2, "")], "doc_id long, source string")
    rows = mixing.mix(sources, block=1).collect()
    assert len(rows) == 4 and {r.slot for r in rows} == {0, 1, 2, 3}


def test_texts_beyond_a_slice(spark):
    """Texts longer than what is encoded at one time, next to empty ones."""
    import public_tokenizers
    from tokenizers import Tokenizer

    big = " ".join(f"Word{k}, of{k % 7}!" for k in range(900_000))
    docs = spark.createDataFrame([(1, ""), (2, big), (3, None), (4, big[:50])], "doc_id long, text string")
    got = {r.doc_id: r.n for r in packing.cut(docs, public_tokenizers.path(TOKENIZER), END_ID).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    n = len(Tokenizer.from_file(public_tokenizers.path(TOKENIZER)).encode(big, add_special_tokens=False).ids)
    assert got[1] == got[3] == 1 and got[2] == n + 1 and got[4] > 1
