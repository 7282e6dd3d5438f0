"""Connected components of a table of links, by stars inside tasks and contraction, and the roots of a forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import discard, give_back, settle

MAX_ROUNDS = 200
#: Links of a task, which are put together at one time, about.
CHUNK = 500_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links (u, v) that isn't the smallest of its component, and that smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    top = np.arange(len(nodes))
    while True:
        low, high = np.minimum(top[a], top[b]), np.maximum(top[a], top[b])
        apart = low != high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(top, high[apart], low[apart])
        while (top[top] != top).any():
            top = top[top]
    below = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[below], nodes[top[below]]


def stars_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of a partition's links, chunk after chunk."""

    def joined() -> pa.RecordBatch:
        u, v = stars(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield joined()
            held, rows = [], 0
    if rows:
        yield joined()
    give_back()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links(u, v), component being the smallest node that it reaches.

    There is a task for CHUNK links, whatever the number of shuffle partitions, and each puts a star around the smallest
    node of each component among its links. Links that fit into one task are done by that, without a join. Others are
    contracted: every node hooks onto its smallest centre, which is smaller than itself, so that these make a forest; links are
    then carried over to its roots, and those inside one tree go. A root that isn't done has a smaller neighbour after that, or has
    taken in another node, so two rounds halve the nodes of an unfinished component at least, and a round joins only
    links that the ones before have left. The joins meet one label row a node, so a node with very many links only
    makes a join side that adaptive execution can split. Labels are written to the shared folder, and none
    of them is broadcast: that would pass through the driver two or three times a round.
    """
    left, labels, used = downward(links), None, []
    for _ in range(MAX_ROUNDS):
        left = settle(left, "links")
        discard(*used)
        tasks = -(-left.count() // CHUNK)
        starred = left.coalesce(max(tasks, 1)).mapInArrow(stars_of, "u long, v long")
        if tasks <= 1:
            tops = starred.select(F.col("u").alias("node"), F.col("v").alias("component"))
            if labels is None:
                out, used = settle(with_roots(tops), "labels"), [left]
            else:
                tops = settle(tops, "tops")
                out, used = settle(with_roots(carried(labels, tops)), "labels"), [left, tops, labels]
            discard(*used)
            return out
        starred = settle(starred, "stars")
        tops = roots(starred.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")))
        used = [left, starred]
        if labels is None:
            labels = tops
        else:
            used += [tops, labels]
            labels = settle(carried(labels, tops), "labels")
        left = downward(onto(onto(starred, tops, "u"), tops, "v"))
    raise RuntimeError(f"links are left after {MAX_ROUNDS} rounds")


def downward(links: DataFrame) -> DataFrame:
    """Distinct links (u, v) with u > v."""
    return links.where("u != v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct()


def onto(rows: DataFrame, tops: DataFrame, at: str) -> DataFrame:
    """rows with the nodes of a column replaced by their components in tops(node, component), where they have one."""
    far = tops.select(F.col("node").alias(at), F.col("component").alias("_far")).hint("merge")
    return rows.join(far, at, "left").select(*(F.coalesce("_far", at).alias(at) if c == at else c for c in rows.columns))


def carried(labels: DataFrame, tops: DataFrame) -> DataFrame:
    """labels carried over to tops(node, component) of their components, and the rows of tops."""
    return onto(labels, tops, "component").union(tops.select("node", "component"))


def with_roots(labels: DataFrame) -> DataFrame:
    """labels(node, component) and a row of each component's own."""
    rows = F.array(F.struct("node", "component"), F.struct(F.col("component").alias("node"), "component"))
    return labels.select(F.explode(rows).alias("row")).select("row.*").distinct()


def roots(parents: DataFrame) -> DataFrame:
    """(node, component) of every node of a forest parents(node, component), component being the root above it; roots have no row.

    Each round a node takes the parent of its parent, so a path of length n closes in log n rounds of one join.
    """
    labels = settle(parents, "parents")
    for _ in range(MAX_ROUNDS):
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        step = labels.join(up.hint("merge"), "component", "left").select("node", F.coalesce("far", "component").alias("component"), F.col("far").isNotNull().alias("moved"))
        new = settle(step, "parents")
        discard(labels)
        labels = new.drop("moved")
        labels.settled_at = new.settled_at
        if new.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"parents still change after {MAX_ROUNDS} rounds")
