"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample of SAMPLE vectors (those of smallest hash) and has at most
MAX_LEAVES leaves; every vector is then placed in a leaf by descending from the root. A query walks the
tree with a priority queue of nodes and visits leaves in that order. The best bin is that with the largest inner product to be
hoped for: that with its centre, and SPREAD times the query's length times the root mean square distance of its vectors from the centre, as
the nearest are seldom at a centre; for nodes that are no leaves it is INNER times as much, as their leaves lie further out. How many it visits is calibrated: on queries drawn from the sample the number is widened until
the recall against brute force over the sample reaches TARGET; a query goes on until it has met more
rows than it needs, so that no answer is short. Only the sample and the tree come to the driver.

Neighbouring leaves are stored together in groups of about ROWS vectors. A query goes to each group that has a leaf for it, is compared with its
leaves there and no others, and gets one answer. A leaf larger than that is a group of its own, split by a hash into blocks of about ROWS vectors; the
queries of a group are split into blocks of QUERIES. Each pair of blocks is one unit of work, so a leaf
that holds a third of all rows, or thousands of equal vectors, is spread over tasks. A unit returns its best k of each query; the best k of
those are chosen by a window whose limit is applied before the shuffle.

Defined results: vectors that are null, empty or zero, that hold null or non-finite components, or whose
length is not the most frequent one (the larger of a tie) take no part. Scores are sums in double precision,
component after component, which may overflow to an infinity; ties go to the smaller vec_id, and sums that are NaN come last. Rows that repeat a vec_id are all candidates, but never
of a query of that vec_id; a query repeated answers once. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pageloom.llm.common import settle

SAMPLE = 20_000
MAX_LEAVES = 4096
LEAF_ROWS = 200
BRANCHES = 8
TARGET = 0.97
TRIALS = 200
ROWS = 4096
QUERIES = 1024
SPREAD, INNER = 0.5, 1.0
#: Components beyond this are scaled for the tree.
HUGE = 1e100


@dataclass(frozen=True)
class Tree:
    """children[node] is (first, last) of its child nodes, or (leaf, -1); centres has a row for each node, and radii how far its vectors lie from it."""

    centres: np.ndarray
    radii: np.ndarray
    children: np.ndarray
    n_leaves: int

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: at every node the child whose centre is nearest."""
        at = np.zeros(len(x), np.int64)
        while True:
            inner = self.children[at, 1] >= 0
            if not inner.any():
                return self.children[at, 0]
            for node in np.unique(at[inner]):
                rows = np.flatnonzero(at == node)
                first, last = self.children[node]
                c = self.centres[first:last]
                at[rows] = first + np.argmin((c * c).sum(1) - 2 * (x[rows] @ c.T), axis=1)

    def walk(self, query: np.ndarray, visits: int, rows: np.ndarray, enough: int) -> list[int]:
        """Leaves in best-bin-first order: `visits` of them, and more until they hold `enough` rows."""
        spread = np.where(self.children[:, 1] < 0, SPREAD, INNER)
        score = self.centres @ query + spread * np.sqrt(query @ query) * self.radii
        heap, out, met = [(-score[0], 0)], [], 0
        while heap and (len(out) < visits or met < enough):
            _, node = heapq.heappop(heap)
            first, last = self.children[node]
            if last < 0:
                if rows[first]:
                    out.append(int(first))
                    met += int(rows[first])
                continue
            for child in range(first, last):
                heapq.heappush(heap, (-score[child], child))
        return out


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Labels 0..k'-1 of Lloyd's algorithm; empty clusters vanish, so k' may be less than k."""
    centres = x[rng.choice(len(x), k, replace=False)]
    labels = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        new = np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)
        if (new == labels).all() and _:
            break
        labels = new
        for j in np.unique(labels):
            centres[j] = x[labels == j].mean(0)
    return np.unique(labels, return_inverse=True)[1]


def fit_tree(x: np.ndarray, leaves: int, seed: int = 7) -> Tree:
    """Splits the largest leaf again until there are enough leaves or none can be split."""
    rng = np.random.default_rng(seed)
    spread = lambda part: float(np.sqrt(((part - part.mean(0)) ** 2).sum(1).mean())) if len(part) else 0.0
    centres, radii, children = [x.mean(0) if len(x) else np.zeros(1)], [spread(x)], [[0, -1]]
    open_leaves = [(-len(x), 0, np.arange(len(x)))]
    n_leaves = 1
    while open_leaves and n_leaves < leaves:
        size, node, rows = heapq.heappop(open_leaves)
        if -size < 2 * BRANCHES:
            break
        labels = k_means(x[rows], min(BRANCHES, leaves - n_leaves + 1), rng)
        n_new = int(labels.max()) + 1
        if n_new < 2:
            continue
        children[node] = [len(centres), len(centres) + n_new]
        for j in range(n_new):
            part = rows[labels == j]
            heapq.heappush(open_leaves, (-len(part), len(centres), part))
            centres.append(x[part].mean(0))
            radii.append(spread(x[part]))
            children.append([0, -1])
        n_leaves += n_new - 1
    number = 0
    for c in children:
        if c[1] < 0:
            c[0], number = number, number + 1
    return Tree(np.array(centres), np.array(radii), np.array(children, np.int64), number)


def calibrate(tree: Tree, x: np.ndarray, k: int, target: float = TARGET, trials: int = TRIALS) -> int:
    """Leaf visits at which sampled queries find `target` of their k best in the sample."""
    if len(x) <= k + 1 or tree.n_leaves == 1:
        return tree.n_leaves
    leaf = tree.place(x)
    rows = np.bincount(leaf, minlength=tree.n_leaves)
    chosen = np.random.default_rng(11).choice(len(x), min(trials, len(x)), replace=False)
    needed = np.zeros(tree.n_leaves + 1)
    for q in chosen:
        order = {number: at for at, number in enumerate(tree.walk(x[q], tree.n_leaves, rows, 0))}
        scores = x @ x[q]
        scores[q] = -np.inf
        for best in np.argpartition(-scores, k)[:k]:
            needed[order[int(leaf[best])] + 1] += 1
    share = np.cumsum(needed) / needed.sum()
    return int(np.searchsorted(share, target)) or 1


def grouped(counts: np.ndarray, rows: int) -> np.ndarray:
    """The group of each leaf: leaves in turn share a group until it would hold more than `rows`."""
    out, group, held = np.zeros(len(counts), np.int64), 0, 0
    for leaf, n in enumerate(counts.tolist()):
        if held and held + n > rows:
            group, held = group + 1, 0
        out[leaf] = group
        held += n
    return out


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def best_of(queries: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, spans: list[tuple[np.ndarray, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of the k best of each query, ties to the smaller id.

    spans has, for stretches of x, which queries are compared with them, in ascending order.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    with np.errstate(over="ignore", invalid="ignore"):
        return _best_of(queries, own, x, ids, k, spans, out)


def _best_of(queries, own, x, ids, k, spans, out):
    norms = np.sqrt((x * x).sum(1).max())
    for low in range(0, len(queries), 64):
        q = queries[low : low + 64]
        rough, met = np.full((len(q), len(x)), -np.inf), np.zeros((len(q), len(x)), bool)
        for asking, begin, end in spans:
            here = asking[slice(*np.searchsorted(asking, (low, low + 64)))]
            rough[here - low, begin:end] = queries[here] @ x[begin:end].T
            met[here - low, begin:end] = True
        met &= own[low : low + 64, None] != ids[None, :]
        rough[~met] = -np.inf
        kth = np.partition(rough, max(0, rough.shape[1] - k), axis=1)[:, max(0, rough.shape[1] - k)]
        slack = 1e-12 * norms * np.sqrt((q * q).sum(1)) * x.shape[1]
        # where a product or the slack has overflowed, rough scores decide nothing and all rows are scored
        unsure = ~np.isfinite(slack) | (met & ~np.isfinite(rough)).any(1)
        row, col = np.nonzero(met & (unsure[:, None] | (rough >= (kth - slack)[:, None])))
        exact = np.zeros(len(row))
        for d in range(x.shape[1]):
            exact += q[row, d] * x[col, d]
        order = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        out.append((row[keep] + low, ids[col[keep]], exact[keep]))
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def nearest(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found to each row of vectors that is_query marks, and how many rows it was compared with."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    largest = F.max(F.array_max(F.transform("vector", lambda v: F.abs(v).cast("double"))))
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), largest.alias("largest")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, searched bigint")
    dim, n, largest = sizes[0]
    # the tree sees huge vectors smaller, as their squares would overflow; a power of two changes no order
    scale = 2.0 ** -math.frexp(largest)[1] if largest > HUGE else 1.0
    rows = rows.where(F.size("vector") == dim)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    x = _matrix(sample.column("vector"), dim) * scale
    tree = fit_tree(x, min(MAX_LEAVES, max(1, n // LEAF_ROWS), max(1, len(x) // 16)))
    visits = calibrate(tree, x, k)

    @F.arrow_udf(T.IntegerType())
    def leaf_of(column: pa.Array) -> pa.Array:
        return pa.array(tree.place(_matrix(column, dim) * scale), pa.int32())

    placed = settle(rows.withColumn("leaf", leaf_of("vector")), "placed")
    counts = np.zeros(tree.n_leaves, np.int64)
    for leaf, held in placed.groupBy("leaf").count().collect():  # MAX_LEAVES rows at most
        counts[leaf] = held
    groups = grouped(counts, ROWS)
    n_groups = int(groups.max()) + 1
    n_blocks = np.maximum(1, -(-np.bincount(groups, counts, n_groups).astype(np.int64) // ROWS))

    unit_type = T.StructType([T.StructField("group", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("leaves", T.ArrayType(T.IntegerType())), T.StructField("searched", T.LongType())])

    @F.arrow_udf(T.ArrayType(unit_type))
    def units_of(column: pa.Array) -> pa.Array:
        out = []
        for q in _matrix(column, dim) * scale:
            visited: dict[int, list[int]] = {}
            for leaf in tree.walk(q, visits, counts, k + 1):
                visited.setdefault(int(groups[leaf]), []).append(leaf)
            searched = sum(int(counts[leaves].sum()) for leaves in visited.values())
            out.append([{"group": g, "block": b, "leaves": leaves, "searched": searched} for g, leaves in visited.items() for b in range(int(n_blocks[g]))])
        return pa.array(out, pa.list_(pa.struct([("group", pa.int32()), ("block", pa.int32()), ("leaves", pa.list_(pa.int32())), ("searched", pa.int64())])))

    asked = placed.where("asks").dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), "vector", units_of("vector").alias("units"))
    asked = settle(asked.select("query_id", "vector", F.explode("units").alias("unit")).select("query_id", "vector", "unit.*"), "asked")
    askers = np.zeros(n_groups, np.int64)
    for group, held in asked.where("block = 0").groupBy("group").count().collect():
        askers[group] = held
    n_parts = np.maximum(1, -(-askers // QUERIES))
    # MAX_LEAVES rows at most, both
    leaf_groups = F.broadcast(spark.createDataFrame([(j, int(g)) for j, g in enumerate(groups)], "leaf int, group int"))
    split = F.broadcast(spark.createDataFrame([(j, int(b), int(p)) for j, (b, p) in enumerate(zip(n_blocks, n_parts, strict=True))], "group int, blocks int, parts int"))
    left = asked.join(split, "group").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
    right = placed.join(leaf_groups, "leaf").join(split, "group").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def unit(asked_here: pa.Table, held_here: pa.Table) -> pa.Table:
        if not asked_here.num_rows or not held_here.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "searched": pa.array([], pa.int64())})
        held_here = held_here.sort_by("leaf")
        own, queries = asked_here.column("query_id").to_numpy(), _matrix(asked_here.column("vector"), dim)
        x, ids, leaf = _matrix(held_here.column("vector"), dim), held_here.column("vec_id").to_numpy(), held_here.column("leaf").to_numpy()
        here, starts = np.unique(leaf, return_index=True)
        wanted = asked_here.column("leaves").combine_chunks()
        who, of = np.repeat(np.arange(len(own)), np.diff(wanted.offsets.to_numpy())), wanted.flatten().to_numpy()
        spans = [(np.sort(who[of == number]), low, high) for number, low, high in zip(here.tolist(), starts.tolist(), [*starts[1:].tolist(), len(leaf)], strict=True)]
        at, found, score = best_of(queries, own, x, ids, k, spans)
        return pa.table({"query_id": own[at], "vec_id": found, "score": score, "searched": asked_here.column("searched").to_numpy()[at]})

    keys = ["group", "block", "part"]
    found = (
        left.select(*keys, "query_id", "vector", "leaves", "searched")
        .groupBy(*keys)
        .cogroup(right.select(*keys, "leaf", "vec_id", "vector").groupBy(*keys))
        .applyInArrow(unit, "query_id bigint, vec_id bigint, score double, searched bigint")
    )
    order = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "searched")
