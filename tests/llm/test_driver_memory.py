"""What near-duplicate search asks of the driver: small plans, and no labels that are broadcast."""

import re

import numpy as np
import pyarrow as pa
import pytest

from pageloom.llm import components, minhash_dedup


@pytest.fixture
def plans(monkeypatch):
    """(name, plan before it runs) of each table that near-duplicate search writes."""
    seen, plain = [], components.settle

    def settle(df, name):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return plain(df, name)

    for module in (components, minhash_dedup):
        monkeypatch.setattr(module, "settle", settle)
    return seen


def family(n):
    """Texts that share three fifths of their words, with a near copy of every tenth."""
    docs, common = [], [f"c{k}" for k in range(90)]
    for k in range(n):
        docs.append((2 * k, " ".join(common + [f"o{k}x{j}" for j in range(60)])))
        if k % 10 == 0:
            docs.append((2 * k + 1, docs[-1][1].replace(f"o{k}x30", "new")))
    return docs


def test_plans_stay_small(spark, plans, monkeypatch):
    """Tables that are used twice are written once, so no plan holds the work of several steps many times over."""
    monkeypatch.setattr(minhash_dedup, "NODES", 40)
    got = minhash_dedup.find_components(spark.createDataFrame(family(100), "doc_id long, text string"))
    plans.append(("result", got._jdf.queryExecution().executedPlan().toString()))
    assert {r.doc_id: r.component_id for r in got.collect()} == {d: d - d % 2 for d, _ in family(100)}
    joins = {name: 0 for name, _ in plans}
    for name, plan in plans:
        joins[name] = max(joins[name], len(re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash|BroadcastNestedLoop)Join\b", plan)))
    assert "rare_links" in joins  # the family was refined
    assert max(joins.values()) <= 4, joins


def test_plans_of_the_pipeline_stage_stay_small(spark, plans, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "NODES", 40)
    docs = spark.createDataFrame(family(100), "doc_id long, text string")
    assert sorted(r.doc_id for r in minhash_dedup.keep_one(docs).collect()) == [2 * k for k in range(100)]
    assert "rare_links" in dict(plans)
    assert max(len(re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash|BroadcastNestedLoop)Join\b", plan)) for _, plan in plans) <= 4


def test_labels_are_not_broadcast(spark, plans):
    links = spark.createDataFrame([(k, k + 1) for k in range(20)], "u long, v long")
    assert {r.component for r in components.connected_components(links).collect()} == {0}
    parents = spark.createDataFrame([(k + 1, k) for k in range(20)], "node long, component long")
    assert {r.component for r in components.roots(parents).collect()} == {0}
    rounds = [plan for name, plan in plans if name in ("labels", "parents") and "Join" in plan]
    assert len(rounds) > 4
    assert not any("Broadcast" in plan for plan in rounds)


def shuffled_path(n):
    """A path through the nodes 0 to n - 1 in an order without pattern."""
    order = np.random.default_rng(7).permutation(n)
    return [(int(a), int(b)) for a, b in zip(order, order[1:], strict=False)]


def test_long_paths_take_few_rounds_of_one_join(spark, plans):
    """Each round is a few jobs, and what the driver holds grows with jobs: tasks put their own links together before."""
    got = components.connected_components(spark.createDataFrame(shuffled_path(2000), "u long, v long"))
    assert {r.component for r in got.collect()} == {0} and got.count() == 2000
    rounds = [plan for _, plan in plans if "Join" in plan]
    assert len(plans) <= 4 and len(rounds) <= 2, [name for name, _ in plans]
    assert all(len(re.findall(r"SortMergeJoin\b", plan)) == 1 for plan in rounds)


def test_components_across_tasks(spark):
    links = shuffled_path(300) + [(1000 + a, 1000 + b) for a, b in shuffled_path(40)] + [(5000, k) for k in range(5001, 5200)] + [(9, 9), (7000, 7000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: 0 for k in range(300)} | {k: 1000 for k in range(1000, 1040)} | {k: 5000 for k in range(5000, 5200)}


def test_stars_of_chunks(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"u": [5, 9, 3, 8], "v": [9, 7, 8, 2]})
    later = pa.RecordBatch.from_pydict({"u": [7], "v": [1]})
    pairs = lambda: [sorted(zip(*b.to_pydict().values(), strict=True)) for b in components.stars_of(iter([batch, later]))]
    assert pairs() == [[(3, 2), (5, 1), (7, 1), (8, 2), (9, 1)]]
    monkeypatch.setattr(components, "CHUNK", 4)
    assert pairs() == [[(3, 2), (7, 5), (8, 2), (9, 5)], [(7, 1)]]


def near_group(n, hubs):
    """Links of n members of one group with six of its hubs each, as buckets give them, and another group of two."""
    draw = np.random.default_rng(3)
    links = [(k, int(h)) for k in range(hubs, n) for h in draw.choice(hubs, 6, replace=False)]
    return [*links, (n, n + 1)], {k: 0 for k in range(n)} | {n: n, n + 1: n}


def test_large_groups_meet_no_join_in_many_partitions(spark, plans):
    """Tasks go by the number of links, not by that of shuffle partitions: a round was a join of every link, and took place again and again."""
    links, want = near_group(3000, 60)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dict(got) == want and len(got) == len(want)
    assert not [name for name, plan in plans if "Join" in plan]


@pytest.mark.parametrize("links, want", [near_group(400, 40), (shuffled_path(300) + [(900, 901)], {k: 0 for k in range(300)} | {900: 900, 901: 900})])
def test_links_of_many_tasks_are_contracted(spark, monkeypatch, links, want):
    """A round joins only what the rounds before have left."""
    left, plain = [], components.settle

    def settle(df, name):
        out = plain(df, name)
        left.extend([out.count()] if name == "links" else [])
        return out

    monkeypatch.setattr(components, "settle", settle)
    monkeypatch.setattr(components, "CHUNK", 20)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")  # a task a file or two
    try:
        got = [tuple(r) for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert dict(got) == want and len(got) == len(want)
    assert len(left) > 1 and left == sorted(left, reverse=True) and sum(left) < 2 * left[0], left


def test_near_copies_in_many_partitions_join_no_labels(spark, plans):
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join([*words[:30], f"x{k}", *words[30:]])) for k in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r.component_id for r in minhash_dedup.find_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == dict.fromkeys(range(40), 0)
    labels = [plan for name, plan in plans if name == "labels"]
    assert labels and not any("Join" in plan for plan in labels)


def test_exploded_keys_are_not_broadcast(spark, tmp_path):
    """Spark sizes an exploded table as the one before, 100 times too low, and at its own threshold would send it through the driver."""
    pieces = [[k * 100 + j for j in range(minhash_dedup.SIDE)] for k in range(50)]
    spark.createDataFrame([(k // 2, p, p) for k, p in enumerate(pieces + pieces)], "node long, first array<long>, second array<long>").write.parquet(f"{tmp_path}/nodes")
    links = minhash_dedup.candidate_links(spark.read.parquet(f"{tmp_path}/nodes"))
    assert links.count() > 0
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_the_pipeline_stage_broadcasts_no_exploded_keys(spark, plans):
    docs = spark.createDataFrame(family(100), "doc_id long, text string")
    assert minhash_dedup.keep_one(docs).count() == 100
    assert "BroadcastExchange" not in dict(plans)["candidates"]
