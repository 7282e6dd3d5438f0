"""Packing documents into sequences of bounded length by the sum-of-squares rule.

Documents are encoded once; those longer than a sequence are cut into full pieces and a rest. Pieces
are dealt by a hash into shards of about SHARD pieces, and each shard is packed by one task, longest
pieces first: with N(g) open sequences that have g places left, a piece goes where the sum of N(g)**2
over all gaps becomes smallest, a new sequence being one of the choices. That keeps gaps of all sizes
in stock, so that later pieces close sequences exactly. Sequences that a round leaves less full than
FULL are opened again, and their pieces, which come from all shards, are packed together in the next
round, whose shards are fewer; the last round keeps whatever it makes. Only lengths and ids of pieces
are shuffled, and a task never holds more than about SHARD of them.

Documents that have a place (in_file_order) are not dealt by a hash: a shard is a stretch of RANGE places, and of
WIDER times as many in each later round, and sequences are numbered by the stretches they come from. So sequences in the order of
their ids follow the order of the documents, by which a mixture keeps its shares in every stretch.

Defined results: a null or empty text is the end id alone. Repeated rows are packed each on its own.
Empty tables give empty results; other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.llm import tokens
from pageloom.llm.common import give_back, settle

CAPACITY = 4096
SHARD = 40_000
FULL = 0.99
ROUNDS = 3
RANGE, WIDER = 4_000, 8
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def in_file_order(docs: DataFrame, place: str = "place") -> DataFrame | None:
    """doc_id, text and the place of each row of docs in its files, which are taken in the order of their names; None if docs don't stand in files."""
    try:
        rows = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return None
    # a row for each file of the table
    files = rows.groupBy("file").agg((F.max("row") + 1).alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(files, "file").select("doc_id", "text", (F.col("base") + F.col("row")).alias(place))


def cut(docs: DataFrame, tokenizer: str, end_id: int | None = 1, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, the place of the document if docs have one, and ids if asked for."""
    placed = ["place"] if "place" in docs.columns else []

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        for batch in batches:
            for row, ids, ends in tokens.in_slices(encoder, batch.column(1), end_id):
                sizes = np.diff(ends, prepend=0)
                n_pieces = -(-sizes // capacity)
                own = np.repeat(np.arange(len(ends)), n_pieces)
                number = np.arange(len(own)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = number * capacity
                length = np.minimum(capacity, sizes[own] - start)
                at = (ends - sizes)[own] + start
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [batch.column(0).slice(row, len(ends)).take(pa.array(own)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
                if placed:
                    columns.append(batch.column(2).slice(row, len(ends)).take(pa.array(own)))
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids, pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", *placed, *["ids"] * keep_ids])
        give_back()

    return docs.select("doc_id", "text", *placed).mapInArrow(pieces, PIECES + ", place bigint" * len(placed) + ", ids array<bigint>" * keep_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each length, taken in the given order, and how full each sequence is."""
    counts = np.zeros(capacity + 1, np.int64)  # open sequences by places left
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, filled = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for k, size in enumerate(lengths.tolist()):
        # a gap g that becomes g - size changes the sum by 2 * (counts[g - size] - counts[g] + 1), or, closed, by 1 - 2 * counts[g]
        change = counts[: capacity + 1 - size] - counts[size:] + 1
        change[0] = -counts[size]
        change[counts[size:] == 0] = np.iinfo(np.int64).max
        best = int(np.argmin(change))
        fresh = counts[capacity - size] if size < capacity else -1
        if change[best] == np.iinfo(np.int64).max or change[best] > fresh:
            where[k] = len(filled)
            filled.append(size)
            gap = capacity - size
        else:
            gap = best
            where[k] = seq = open_by_gap[gap + size].pop()
            counts[gap + size] -= 1
            offset[k] = filled[seq]
            filled[seq] += size
        if gap:
            open_by_gap[gap].append(int(where[k]))
            counts[gap] += 1
    return where, offset, np.array(filled, np.int64)


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_size: int = SHARD, rounds: int = ROUNDS) -> DataFrame:
    """pieces with sequence_id and offset, and without their place. pieces must be a settled table, as it is read in each round."""
    schema = pieces.schema
    fields = [f.name for f in schema]
    placed = "place" in fields
    out_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", sequence_id bigint, offset bigint, sequence_full double"

    def packer(round_no: int, width: int):
        def shard(table: pa.Table) -> pa.Table:
            own = int(table.column("shard")[0].as_py())
            table = table.sort_by([("length", "descending"), *[(c, "ascending") for c in fields if c in ("doc_id", "piece", "ids_crc32")]])
            where, offset, filled = sum_of_squares(table.column("length").to_numpy(), capacity)
            table = table.select(fields)
            # the shard, the round and the number in the shard; a stretch is named by where it begins
            name = (own * width << 24) + (round_no << 22) if placed else (round_no << 56) + (own << 24)
            table = table.append_column("sequence_id", pa.array(name + where, pa.int64()))
            table = table.append_column("offset", pa.array(offset, pa.int64()))
            return table.append_column("sequence_full", pa.array(filled[where] / capacity, pa.float64()))

        return shard

    done, todo = [], pieces
    for k in range(rounds):
        width = WIDER**k
        if placed:
            key = F.floor(F.col("place") / (RANGE * width)).alias("shard")
        else:
            shards = max(1, -(-todo.count() // shard_size))
            key = F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(shards)).alias("shard")
        packed = settle(todo.select(key, *fields).groupBy("shard").applyInArrow(packer(k, width), out_ddl), f"packed_{k}")
        done.append(packed if k == rounds - 1 else packed.where(F.col("sequence_full") >= FULL))
        todo = packed.where(F.col("sequence_full") < FULL).select(*fields)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("sequence_full", "place")
