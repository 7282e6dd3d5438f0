"""Pieces that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

LIBC = ctypes.CDLL(None)
#: Where a session on one machine remembers the folder that it was given.
SET_HERE = "_pageloom_shared"
#: The white space that separates words, as characters.
WORD_GAPS = " \t\n\x0b\x0c\r"
#: Odd multipliers for the places of a window, from the golden ratio.
WEIGHTS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) & ((1 << 64) - 1) | 1 for k in range(1, 17)], np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Where it is unset, one is set for a session on one machine, and no other runs."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, SET_HERE, None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="pageloom-")
        spark.sparkContext.setCheckpointDir(found)
        setattr(spark, SET_HERE, found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again, which cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pageloom/{re.sub(r'[^a-z0-9_]', '_', name.lower())}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes settled tables that nothing will read again."""
    for df in frames:
        path = df.settled_at
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns that clash with none of df's, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """Returns freed memory of a Python worker to the system; workers live on after their task."""
    pa.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)


def in_turn(function: Callable[[pa.Array], pa.Array]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """function over the batches of a partition, with freed memory given back at its end."""

    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield function(column)
        give_back()

    return batches


def word_ids(words: list[bytes]) -> np.ndarray:
    """Numbers the distinct words of one text in order of first use."""
    seen: defaultdict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(seen.__getitem__, words), np.int64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit integers (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of width numbers: an odd-weighted sum of mixed values, mixed again."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mixed = mix64(ids.astype(np.uint64) + np.uint64(1))
    out = mixed[:n] * WEIGHTS[0]
    for k in range(1, width):
        out += mixed[k : k + n] * WEIGHTS[k]
    return out
