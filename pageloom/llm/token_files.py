"""Token-id files in patched frame-of-reference blocks.

A data set of token files is a folder of shards. Documents are ordered by doc_id over the shards (range
partitioned, then sorted), and each shard is one Parquet file of segments, written by Spark's own
committer, so that a lost task leaves nothing behind and any store works. A segment holds whole documents, about
SEGMENT ids or one longer document, as

* shard, segment, start: place of the segment; start counts the shard's ids before it,
* doc_ids, lengths: its documents and their numbers of ids,
* block_starts: the byte at which each block begins (the index for reading a part),
* payload: the blocks.

A block holds BLOCK ids (the last of a segment fewer) as: minimum (uint32), number of ids (uint16), width in bits (uint8), a zero
byte, number of exceptions (uint16), then the ids less the minimum packed at the width, least bit first,
then the positions (uint16) and full values (uint32) of the exceptions, all little-endian. The width is
what PERCENTILE of the block's values need; values that need more are the exceptions, and leave their low bits in the packed part.

Defined results: a null or empty text is the end id alone. Null doc_ids come first; rows with one
doc_id follow each other in the order of their texts' hash. An empty table gives an empty data set. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import tokens
from pageloom.llm.common import give_back

BLOCK = 1024
SEGMENT = 1 << 16
PERCENTILE = 95
HEAD = struct.Struct("<IHBBH")
SCHEMA = "shard int, segment int, start bigint, doc_ids array<bigint>, lengths array<bigint>, block_starts array<int>, n_ids bigint, payload binary"
ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("segment", pa.int32()),
        ("start", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("block_starts", pa.list_(pa.int32())),
        ("n_ids", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def bits_needed(values: np.ndarray) -> np.ndarray:
    """Bits of each value: 0 for 0. Exact for 32 bits, as doubles hold them."""
    return np.frexp(values.astype(np.float64))[1]


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low bits of 32-bit values, least bit first: eight values fill `width` bytes. A row of values gives a row of bytes."""
    n = values.shape[-1]
    padded = np.zeros((*values.shape[:-1], -(-n // 8) * 8), np.uint64)
    padded[..., :n] = values & np.uint32((1 << width) - 1)
    eights = padded.reshape(*values.shape[:-1], -1, 8)
    words = np.zeros((*eights.shape[:-1], 5), np.uint64)
    for k in range(8):
        word, shift = divmod(k * width, 64)
        words[..., word] |= eights[..., k] << np.uint64(shift)
        if shift + width > 64:
            words[..., word + 1] |= eights[..., k] >> np.uint64(64 - shift)
    return words.astype("<u8", copy=False).view(np.uint8)[..., :width].reshape(*values.shape[:-1], -1)[..., : -(-n * width // 8)]


def unpack_bits(packed: np.ndarray, n: int, width: int) -> np.ndarray:
    """The n values that pack_bits has packed."""
    groups = -(-n // 8)
    padded = np.zeros(groups * width, np.uint8)
    padded[: len(packed)] = packed
    wide = np.zeros((groups, 40), np.uint8)
    wide[:, :width] = padded.reshape(groups, width)
    words = wide.view("<u8")
    out = np.empty((groups, 8), np.uint64)
    for k in range(8):
        word, shift = divmod(k * width, 64)
        out[:, k] = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            out[:, k] |= words[:, word + 1] << np.uint64(64 - shift)
    return (out & np.uint64((1 << width) - 1)).astype(np.uint32).ravel()[:n]


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """One block for each row of ids; blocks of one width are packed together."""
    n = ids.shape[1]
    lows = ids.min(1)
    rest = ids - lows[:, None]
    at = min(n - 1, int(n * percentile / 100))
    widths = bits_needed(np.partition(rest, at, axis=1)[:, at])
    out: list[bytes] = [b""] * len(ids)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        packed = pack_bits(rest[rows], width) if width else np.zeros((len(rows), 0), np.uint8)
        for row, part in zip(rows.tolist(), packed, strict=True):
            places = np.flatnonzero(rest[row] >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
            head = HEAD.pack(int(lows[row]), n, width, 0, len(places))
            out[row] = b"".join((head, part.tobytes(), places.astype("<u2").tobytes(), rest[row, places].astype("<u4").tobytes()))
    return out


def decode_block(payload: bytes | memoryview, at: int = 0) -> np.ndarray:
    low, n, width, _, n_out = HEAD.unpack_from(payload, at)
    at += HEAD.size
    size = -(-n * width // 8)
    rest = unpack_bits(np.frombuffer(payload, np.uint8, size, at), n, width) if width else np.zeros(n, np.uint32)
    at += size
    places = np.frombuffer(payload, "<u2", n_out, at)
    rest[places] = np.frombuffer(payload, "<u4", n_out, at + 2 * n_out)
    return rest + np.uint32(low)


def encode_ids(ids: np.ndarray) -> tuple[list[int], bytes]:
    """Where each block starts, and the blocks."""
    ids = ids.astype(np.uint32, copy=False)
    full = len(ids) // BLOCK * BLOCK
    parts = encode_blocks(ids[:full].reshape(-1, BLOCK)) if full else []
    if full < len(ids):
        parts += encode_blocks(ids[None, full:])
    return [0, *np.cumsum([len(p) for p in parts[:-1]], dtype=int).tolist()][: len(parts)], b"".join(parts)


def decode_ids(payload: bytes, block_starts: list[int], first: int = 0, n: int | None = None) -> np.ndarray:
    """The ids of a segment, or n of them from `first` on, for which only their blocks are read."""
    last = len(block_starts) if n is None else -(-(first + n) // BLOCK)
    begin = first // BLOCK
    blocks = [decode_block(payload, s) for s in block_starts[begin:last]]
    ids = np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)
    return ids[first - begin * BLOCK :][: len(ids) if n is None else n]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1) -> None:
    """Encodes docs(doc_id, text) and writes the data set at path."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = tokens.encoder(tokenizer), TaskContext.get().partitionId()
        number = start = held = 0
        docs_held: list[int | None] = []
        ids_held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, start, held
            block_starts, payload = encode_ids(np.concatenate(ids_held))
            row = [shard, number, start, list(docs_held), [len(i) for i in ids_held], block_starts, held, payload]
            number, start, held = number + 1, start + held, 0
            docs_held.clear()
            ids_held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, ARROW, strict=True)], schema=ARROW)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for row, ids, ends in tokens.in_slices(encoder, batch.column(1), end_id):
                begin = 0
                for k, end in enumerate(ends.tolist()):
                    docs_held.append(doc_ids[row + k])
                    ids_held.append(ids[begin:end])
                    held, begin = held + end - begin, end
                    if held >= SEGMENT:
                        yield flush()
        if docs_held:
            yield flush()
        give_back()

    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ranged = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(segments, SCHEMA).write.parquet(path)


def shard_bases(files: DataFrame) -> DataFrame:
    """(shard, base): the ids of all earlier shards. One row a shard, that is, a write task."""
    totals = sorted((r[0], r[1]) for r in files.groupBy("shard").agg(F.sum("n_ids")).collect())
    bases, base = [], 0
    for shard, n in totals:
        bases.append((shard, base))
        base += n
    return files.sparkSession.createDataFrame(bases, "shard int, base bigint")


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if asked for, from the files."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "shard", "local", "n_tokens", "ids_crc32", "ids"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        width = 5 + keep_ids
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_ids(row["payload"], row["block_starts"]).astype("<u4")
                ends = np.cumsum(row["lengths"]).tolist()
                own = [ids[e - n : e] for n, e in zip(row["lengths"], ends, strict=True)]
                columns = [
                    row["doc_ids"],
                    [row["shard"]] * len(own),
                    [row["start"] + e - n for n, e in zip(row["lengths"], ends, strict=True)],
                    row["lengths"],
                    [zlib.crc32(i.tobytes()) for i in own],
                    own if keep_ids else None,
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:width], types, strict=False)], names=names[:width])

    files = spark.read.schema(SCHEMA).parquet(path)
    bases = shard_bases(files)
    schema = "doc_id bigint, shard int, local bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * keep_ids
    rows = files.select("shard", "segment", "start", "doc_ids", "lengths", "block_starts", "payload").mapInArrow(documents, schema)
    rest = ["ids"] * keep_ids
    # one small row a shard: as many as the write had tasks
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *rest)
