"""The methods against brute force, round trips and held-out accuracy."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.llm import ann, components, minhash_dedup, mixing, packing, quality_rules, text_stats, token_files, tokens, url_filter
from pageloom.llm.labels import Isotonic


def brute_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghijklmnopqrst") * rng.randint(1, 3) for _ in range(60)) for _ in range(6)]
    docs = []
    for k in range(120):
        words = base[k % 6].split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
        docs.append((k, " ".join(words)))
    sets = {k: brute_sets(t) for k, t in docs}
    label = {k: k for k in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash_dedup.find_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {k: (find(k), len(sets[k])) for k in sets}


def test_large_family_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(200)]
    docs = []
    for k in range(60):
        own = list(words)
        own[rng.randrange(200)] = f"x{k}"
        docs.append((k, " ".join(own)))
    monkeypatch.setattr(minhash_dedup, "BLOCK", 2000)
    got = minhash_dedup.find_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def brute_components(docs):
    """doc_id -> the smallest doc_id that links of at least 0.75 reach."""
    sets = {k: brute_sets(t) for k, t in docs}
    label = {k: k for k in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def test_boilerplate_families_are_refined(spark, monkeypatch):
    """Texts that share three fifths of their words fall into one family; only those that share rare shingles, too, are compared."""
    rng = random.Random(7)
    common = [f"c{k}" for k in range(90)]
    docs = []
    for k in range(150):
        docs.append((3 * k, " ".join(common + [f"o{k}x{j}" for j in range(60)])))
        if k % 10 == 0:  # a near copy, and a near copy of that one only
            words = docs[-1][1].split()
            words[rng.randrange(92, 150)] = "new"
            docs.append((3 * k + 1, " ".join(words)))
            words[rng.randrange(92, 150)] = "newer"
            docs.append((3 * k + 2, " ".join([*words, *(f"n{j}" for j in range(18))])))
    monkeypatch.setattr(minhash_dedup, "NODES", 40)
    compared = []
    plain = minhash_dedup.block_links
    monkeypatch.setattr(minhash_dedup, "block_links", lambda placed, sets: (compared.append(placed.count()), plain(placed, sets))[1])
    got = {r.doc_id: r.component_id for r in minhash_dedup.find_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs)
    assert compared[0] <= 50


def test_large_group_with_outsiders(spark, monkeypatch):
    """Links between the largest cluster of a family and sets that their star did not confirm."""
    base = [f"w{k}" for k in range(120)]
    docs = []
    for k in range(90):
        own = list(base)
        for j in range(k % 9):  # further and further from the first, by steps that are links
            own[12 * j : 12 * j + 4] = [f"x{j}a", f"x{j}b", f"x{j}c", f"x{j}d"]
        docs.append((k, " ".join([*own, f"y{k}"])))
    monkeypatch.setattr(minhash_dedup, "NODES", 20)
    got = {r.doc_id: r.component_id for r in minhash_dedup.find_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs)


def test_connected_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r[0]: r[1] for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\t#|é", max_size=120))
def test_text_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    inside = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    got = dict(zip(text_stats.FIELDS, text_stats.stats_of(text), strict=True))
    assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words)) and got["n_repeat_words"] == len(inside)
    assert got["n_dup_lines"] == len(lines) - len(set(lines)) and got["n_symbols"] == sum(c in "#*$%&|<>" for c in text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=3000), st.integers(0, 40))
def test_blocks_round_trip(ids, shift):
    x = np.array(ids, np.uint32) >> np.uint32(min(shift, 31))
    starts, payload = token_files.encode_ids(x)
    assert (token_files.decode_ids(payload, starts) == x).all()
    first = len(x) // 3
    assert (token_files.decode_ids(payload, starts, first, len(x) - first) == x[first:]).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_word_by_word_encoding(texts):
    import public_tokenizers

    encoder = tokens.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder.by_words
    extra = ["Ünï'S İstanbul.\nfoo, bar-. <|endoftext|>! <|ENDOFTEXT|> É½ don't x's. é́ ŉ a.b., ὈΔΥΣΣΕΎΣ"]
    texts = [*texts, *extra, "".join(texts), "(It's 12.5%) a-b_c [É]+ÿ ²½ª"]
    ids, ends = encoder.flat(pa.array(texts, pa.string()), 1)
    for text, begin, end in zip(texts, [0, *ends[:-1]], ends, strict=True):
        assert ids[begin:end].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1]
    other = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_words and other.ids("a b").tolist() == other.tokenizer.encode("a b", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=300))
def test_sum_of_squares(lengths):
    where, offset, filled = packing.sum_of_squares(np.array(sorted(lengths, reverse=True), np.int64), 50)
    assert filled.sum() == sum(lengths) and (filled <= 50).all() if lengths else len(filled) == 0
    # never more than twice the least possible and one
    assert len(filled) <= 2 * -(-sum(lengths) // 50) + 1


def ideal_shares(blocks, weights):
    """How many blocks of each source the ideal mixture has after every slot: sources flow at their weights until they run out."""
    n, w = np.array(blocks, float), np.array([float(x) for x in weights])
    have, out = np.zeros(len(n)), []
    for _ in range(sum(blocks)):
        left = 1.0
        while left > 1e-12:
            open_now = have < n - 1e-9
            if not open_now.any():
                break
            rate = np.where(open_now, w, 0) / w[open_now].sum()
            step = min(left, ((n - have)[open_now] / rate[open_now]).min())
            have, left = have + rate * step, left - step
        out.append(have)
    return np.array(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.sampled_from([1, 2, 7, 60, 0.1, 1 / 3, 0.123456789, 0.0005])), min_size=1, max_size=12))
def test_pfair_deviation(sources):
    blocks, weights = [n for n, _ in sources], [w for _, w in sources]
    no = mixing.plan(blocks, weights).column("no").to_numpy()
    taken = np.cumsum(no[:, None] == np.arange(len(blocks)), axis=0)
    assert taken[-1].tolist() == blocks
    assert np.abs(taken - ideal_shares(blocks, weights)).max() < 1 + 1e-6


def test_mixture_keeps_its_weights(spark):
    """Through mix itself, over all slots: the given weights, equal ones, zero weights, a source that isn't weighted, ties."""
    for weights, sizes in (({}, [300, 500, 700]), ({"s0": 3, "s1": 1, "s2": 1, "s3": 1}, [900, 200, 300, 400]), ({"s0": 0.0005, "s1": 0.9995, "s2": 0}, [40, 900, 100]), ({"s1": 2.5, "s0": 1 / 3}, [300, 800, 0, 150])):
        rows = [(k if k % 7 else 0, f"s{s}") for s, n in enumerate(sizes) for k in range(n)]
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=4).collect()
        assert len(got) == len(rows) and len({(r.slot, r.place) for r in got}) == len(rows)
        names = sorted({r[1] for r in rows})
        default = min(weights.values(), default=1.0)
        given_weights = [weights.get(s, default) for s in names]
        source_of = {r.slot: names.index(r.source) for r in got}
        no = np.array([source_of[t] for t in range(len(source_of))])
        blocks = np.bincount(no, minlength=len(names))
        assert blocks.tolist() == [-(-sum(r[1] == s for r in rows) // 4) for s in names]
        weighted = [k for k, w in enumerate(given_weights) if w > 0]
        first = int(blocks[weighted].sum())
        taken = np.cumsum(no[:first, None] == np.array(weighted), axis=0)
        assert np.abs(taken - ideal_shares(blocks[weighted].tolist(), [given_weights[k] for k in weighted])).max() < 1 + 1e-6


def test_many_sources(spark):
    docs = spark.range(6006).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 1001).alias("source"), F.lit(1).alias("S"), F.lit(2).alias("no_"), F.lit(3).alias("its"))
    got = mixing.mix(docs, block=2).groupBy("slot").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.max("S"), F.max("no_")).collect()
    assert len(got) == 3003 and {tuple(r)[1:] for r in got} == {(2, 1, 1, 2)}


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(3)
    n, rules = 20_000, len(quality_rules.RULES)
    good = rng.random(n) < 0.85
    votes = np.full((n, rules), quality_rules.ABSTAIN)
    for r in range(rules):
        votes[~good & (rng.random(n) < 0.6), r] = quality_rules.BAD
        votes[good & (rng.random(n) < 0.02), r] = quality_rules.BAD
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.expectation_maximisation(patterns, counts)
    assert abs(model.prior - 0.85) < 0.02
    assert ((model.posterior(votes) >= 0.5) == good).mean() > 0.99
    assert quality_rules.expectation_maximisation(patterns[:0], counts[:0]).votes.shape == (rules, 2, 3)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    s = rng.normal(size=500)
    fit = Isotonic(s, (rng.random(500) < 1 / (1 + np.exp(-3 * s))).astype(float))
    out = fit(np.sort(s))
    assert (np.diff(out) > 0).all() and 0 <= out.min() and out.max() <= 1


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + 0.4 * rng.normal(size=(4000, 16))).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(rows, F.col("vec_id") % 50 == 0, 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    y = x.astype(np.float64)
    for q in range(0, 4000, 50):
        s = y @ y[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:10].tolist()))
    assert hits / (80 * 10) >= 0.9


def test_listed_urls(spark, monkeypatch):
    """A filter of one word lets many wrong keys pass; the join removes them all."""
    monkeypatch.setattr(url_filter, "MAX_WORDS", 1)
    listed = spark.createDataFrame([(f"http://site{k}.org/page/{k}",) for k in range(300)] + [("https://User@Example.com:443/%7ea/%2fb#top",), (None,), ("no scheme",)], "url string")
    urls = {"https://SITE7.org./page/7": "block", "http://site7.org/page/7?x": "allow", "http://site7.org/page/8": "allow", "http://example.com/~a/%2Fb": "block", "http://example.com/~a//b": "allow", "http://ok.org/page/9": "allow", "no scheme": "allow", "http://site299.org:80/page/299#a": "block"}
    urls |= {f"http://other{k}.org/page/{k}": "allow" for k in range(200)}
    pages = spark.createDataFrame([(u, 1, "x") for u in urls] + [(None, 1, "x")], "url string, key int, found string")
    rules = spark.createDataFrame([("allow", "ok.org", "/"), ("block", "other3.org", "")], "verdict string, host string, path string")
    urls["http://other3.org/page/3"] = "block"
    got = {r.url: r.verdict for r in url_filter.judge_urls(pages, rules, listed=listed).collect()}
    assert got == urls | {None: "allow"}
    assert url_filter.judge_urls(pages, rules.limit(0), listed=listed.limit(0)).where("verdict = 'allow'").count() == len(got)


def test_hosts_of_very_many_labels(spark):
    long_host = "http://" + ".".join(["a"] * 12_000) + ".example.net/de/8/" + "b" * 100_000
    rules = spark.createDataFrame([("allow", "net", "/de/"), ("block", "example.net", "/de/8")], "verdict string, host string, path string")
    assert [r.rule for r in url_filter.judge_urls(spark.createDataFrame([(long_host,)], "url string"), rules).collect()] == ["example.net/de/8"]


def test_recall_where_the_tree_prunes(spark, tmp_path):
    """100,000 clustered vectors: at least nine in ten of the nearest are found, though a query meets a small share of the rows."""
    rng = np.random.default_rng(8)
    n, dim, k = 100_000, 16, 10
    x = (rng.normal(size=(600, dim))[rng.integers(0, 600, n)] + 0.25 * rng.normal(size=(n, dim))).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    got, searched = {}, {}
    for r in ann.nearest(spark.read.parquet(str(tmp_path / "v.parquet")), F.col("vec_id") % 500 == 0, k).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        searched[r.query_id] = r.searched
    y, hits = x.astype(np.float64), 0
    for q in range(0, n, 500):
        s = y @ y[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argpartition(-s, k)[:k].tolist()))
    assert hits / (len(got) * k) >= 0.9
    assert np.mean(list(searched.values())) < 0.05 * n
    print("recall", hits / (len(got) * k), "share of rows", np.mean(list(searched.values())) / n)
