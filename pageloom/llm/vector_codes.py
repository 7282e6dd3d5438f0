"""Vector code compression: product codes of vectors, by codebooks that are trained in whole numbers.

Each component x becomes floor(SCALE * x), and each vector is cut into equal consecutive parts with a codebook each. A codebook begins as that
part of the vectors with the smallest ids. In each round a kd-tree of every codebook is broadcast; each task looks for the nearest entry of every
part by branch and bound, and adds up counts and sums of the parts by entry, which are added up by entry after a shuffle; the
entries become the floors of their means. A last pass assigns the codes. Exact whole numbers make the results independent of how
rows are dealt: where fixed-size integers could overflow, Python's are used.

The search descends into the nearer half first, and into every box whose least possible distance is at most the best one found. Boxes of an
equal bound are visited, too, so that of equally near entries the lower index wins.

What reaches the driver is the codebooks and one sum for each of their entries: parts * entries * components of a part. It doesn't
grow with the rows.

Defined results: rows whose vector is null, or holds nulls, NaN or infinities, are dropped. So are vectors of another length than that with the smallest
id, and those that can't be cut into equal parts. Rows without id come last in the order of ids; of rows that share an id the smaller vector comes
first. With fewer vectors than entries a codebook has as many entries as there are vectors. Repeated rows are coded each. Errors beyond 64 bits
are given as the largest 64-bit integer. An empty table gives an empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import settle

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries in a leaf of a tree.
LEAF = 8
LARGEST = (1 << 63) - 1
SAFE = 1 << 62


@dataclass
class Box:
    """A node of a kd-tree: the corners of its entries' box, and either two halves or the entries with their indexes."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray
    index: np.ndarray
    axis: int = -1
    cut: int = 0
    halves: tuple[Box, Box] | None = None

    def bound(self, points: np.ndarray) -> np.ndarray:
        """The least squared distance that an entry of this box may have from each point."""
        gap = np.maximum(np.maximum(self.low - points, points - self.high), 0)
        return (gap * gap).sum(1)


def tree_of(entries: np.ndarray, index: np.ndarray | None = None) -> Box:
    """Halves the entries at the median of the widest axis until LEAF are left."""
    index = np.arange(len(entries)) if index is None else index
    low, high = entries.min(0), entries.max(0)
    box = Box(low, high, entries, index)
    axis = int(np.argmax(high - low))
    order = np.argsort(entries[:, axis], kind="stable")
    cut = entries[order[len(order) // 2], axis]
    below = entries[:, axis] < cut
    if len(entries) > LEAF and below.any():
        box.axis, box.cut = axis, cut
        box.halves = tree_of(entries[below], index[below]), tree_of(entries[~below], index[~below])
    return box


def nearest(tree: Box, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the entry nearest to each point; of equally near ones the lowest index."""
    n_entries = len(tree.entries)
    reach = int(max(abs(tree.low).max(), abs(tree.high).max())) + int(abs(points).max(initial=0))
    if points.dtype == object or tree.entries.dtype == object or reach * reach * points.shape[1] * n_entries >= SAFE:
        points = points.astype(object)
    first = points - tree.entries[np.argmin(tree.index)]
    best = (first * first).sum(1) * n_entries  # a distance and an index in one number

    def visit(box: Box, rows: np.ndarray) -> None:
        if len(rows):
            rows = rows[box.bound(points[rows]) <= best[rows] // n_entries]
        if not len(rows):
            return
        own = points[rows]
        if box.halves is None:
            gap = own[:, None, :] - box.entries[None]
            best[rows] = np.minimum(best[rows], ((gap * gap).sum(2) * n_entries + box.index).min(1))
            return
        left = own[:, box.axis] < box.cut
        below, above = box.halves
        visit(below, rows[left])
        visit(above, rows[~left])
        visit(above, rows[left])
        visit(below, rows[~left])

    visit(tree, np.arange(len(points)))
    return (best % n_entries).astype(np.int64), best // n_entries


def whole_numbers(vectors: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * x) of the components of vectors, all of dim finite components: a row for each."""
    values = pc.cast(vectors.flatten(), pa.float64(), safe=False).to_numpy(zero_copy_only=False).reshape(-1, dim)
    if np.abs(values).max(initial=0) < 2.0**44:
        return np.floor(values * SCALE).astype(np.int64)
    ratios = (float(x).as_integer_ratio() for x in values.ravel())
    out = np.empty(values.size, object)
    out[:] = [SCALE * p // q for p, q in ratios]
    return out.reshape(values.shape)


def summed(numbers: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of numbers by their index."""
    wide = numbers.dtype == object or int(abs(numbers).max(initial=0)) * max(len(numbers), 1) >= SAFE
    out = np.zeros((n, numbers.shape[1]), object if wide else np.int64)
    np.add.at(out, index, numbers.astype(out.dtype))
    return out.astype(object)


class Codebooks:
    """The codebooks of all parts: whole numbers by part, entry and component."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries

    @property
    def dim(self) -> int:
        return sum(e.shape[1] for e in self.entries)

    def sha256(self) -> str:
        """Of the decimal components by part, entry and position, with commas between."""
        return hashlib.sha256(",".join(str(int(x)) for e in self.entries for x in e.ravel()).encode()).hexdigest()

    def decoded(self, code: str) -> list[float]:
        """The vector that a code stands for: the middles of the steps of its entries."""
        return [(int(x) + 0.5) / SCALE for k, e in enumerate(self.entries) for x in e[int(code[2 * k : 2 * k + 2], 16)]]


def usable(df: DataFrame, vector: str, parts: int) -> DataFrame:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(F.col(vector).isNotNull() & finite & (F.size(vector) > 0) & (F.size(vector) % parts == 0))


def first_books(df: DataFrame, n_parts: int, n_entries: int) -> Codebooks | None:
    """The parts of the vectors with the smallest ids; None if there are none."""
    order = [F.col("id").asc_nulls_last(), "vector"]
    rows = df.orderBy(*order).limit(n_entries).collect()
    if not rows:
        return None
    dim = len(rows[0].vector)
    if any(len(r.vector) != dim for r in rows):
        rows = df.where(F.size("vector") == dim).orderBy(*order).limit(n_entries).collect()
    whole = whole_numbers(pa.array([r.vector for r in rows], pa.list_(pa.float64())), dim)
    return Codebooks(np.split(whole, n_parts, axis=1))


def searched(trees: list[Box], vectors: pa.Array, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part: its whole numbers, and the indexes and squared distances of the nearest entries."""
    for tree, own in zip(trees, np.split(whole_numbers(vectors, dim), len(trees), axis=1), strict=True):
        yield own, *nearest(tree, own)


def part_sums(shared, dim: int, n_entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of vectors to a row for each part and entry that a task has used: count, and sums as decimal text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, width = shared.value, dim // len(shared.value)
        sums, counts = np.zeros((len(trees), n_entries, width), object), np.zeros((len(trees), n_entries), np.int64)
        for batch in batches:
            for k, (own, index, _) in enumerate(searched(trees, batch.column(0), dim)):
                sums[k] += summed(own, index, n_entries)
                counts[k] += np.bincount(index, minlength=n_entries)
        part, entry = np.nonzero(counts)
        texts = [",".join(map(str, sums[k, e])) for k, e in zip(part, entry, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(texts, pa.string())], ["part", "entry", "n", "sums"])

    return rows


def add_up(key: tuple, tasks: pa.Table) -> pa.Table:
    """One row of the counts and sums that the tasks have for one part and entry."""
    total = [sum(column) for column in zip(*(map(int, text.split(",")) for text in tasks["sums"].to_pylist()), strict=True)]
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "entry": pa.array([key[1].as_py()], pa.int32()), "n": [pc.sum(tasks["n"]).as_py()], "sums": [",".join(map(str, total))]})


def next_books(df: DataFrame, books: Codebooks) -> Codebooks:
    """One round: the floors of the means of what each entry is nearest to; entries that nothing is nearest to stay."""
    sc, n_entries = df.sparkSession.sparkContext, len(books.entries[0])
    shared = sc.broadcast([tree_of(e) for e in books.entries])
    schema = "part int, entry int, n long, sums string"
    sums = df.select("vector").mapInArrow(part_sums(shared, books.dim, n_entries), schema).groupBy("part", "entry").applyInArrow(add_up, schema).collect()
    shared.unpersist()
    entries = [e.astype(object) for e in books.entries]
    for r in sums:
        entries[r.part][r.entry] = [int(x) // r.n for x in r["sums"].split(",")]
    narrow = all(abs(x) < 1 << 53 for e in entries for x in e.ravel())
    return Codebooks([e.astype(np.int64) if narrow else e for e in entries])


def coder(shared, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of (id, label, vector) to (id, label, code, error)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            codes, error = np.zeros((batch.num_rows, len(trees)), np.uint8), np.zeros(batch.num_rows, object)
            for k, (_, index, distance) in enumerate(searched(trees, batch.column(2), dim)):
                codes[:, k] = index
                error += distance
            digits, size = codes.tobytes().hex(), 2 * len(trees)
            error = np.minimum(error, LARGEST).astype(np.int64)
            texts = pa.array([digits[k * size : (k + 1) * size] for k in range(batch.num_rows)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, pa.array(error)], ["id", "label", "code", "error"])

    return rows


def compress(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", n_parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """A table of id, label, code (two hex digits a part, so at most 256 entries) and error, and the codebooks that it was made with."""
    if not 1 <= n_entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    rows = usable(df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")), "vector", n_parts)
    books = first_books(rows, n_parts, n_entries)
    schema = rows.drop("vector").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).schema
    if books is None:
        return df.sparkSession.createDataFrame([], schema), None
    rows = rows.where(F.size("vector") == books.dim)
    for _ in range(rounds):
        books = next_books(rows, books)
    shared = df.sparkSession.sparkContext.broadcast([tree_of(e) for e in books.entries])
    coded = settle(rows.mapInArrow(coder(shared, books.dim), schema), "vector_codes")
    shared.unpersist()
    return coded, books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of the errors of all rows with an equal label, nulls together."""
    total = F.least(F.sum(F.col("error").cast("decimal(19,0)")), F.lit(LARGEST).cast("decimal(29,0)")).cast("long")
    totals = coded.groupBy(F.col("label").alias("of_label")).agg(total.alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")
