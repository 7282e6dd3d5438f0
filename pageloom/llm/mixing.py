"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in the order of a hash, form blocks. In an ideal mixture every source flows at a rate
of its weight over the weights of all sources that still have documents. Block k of a source is released at the
slot in which the ideal mixture begins it, rounded down, and due by the slot in which that ends it, rounded up.
Earliest deadline first over these windows fills every slot, and as the ideal rates add up to one, it keeps all
deadlines: at every slot each source is less than one block from its ideal share. Weights are taken as
written, as whole numbers over a common denominator, and all times are whole-number arithmetic, so nothing drifts.
Every document has exactly one slot.

Blocks hold BLOCK documents, or as many more as keep the number of blocks near BLOCKS: the driver holds a count for
each source and a slot for each block, both bounded by that number and the number of sources, whatever the corpus.
The rank of a document in its source comes from hash buckets of about BUCKET documents, whose counts are added up
in groups of GROUP buckets, so that no task holds a source.

Defined results: null is a source of its own. Sources without a target weight get the smallest one given,
or all the same if none is, and so do those whose weight is NaN; sources of an infinite weight come before all others, and those with a
weight of zero or less after all others are used up, all at one rate among themselves.
Repeated rows each have a place. Empty tables give empty results. Columns named source_block, slot, place or
phase are replaced; all others pass through.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.llm.common import free_names

BLOCK = 16
#: Blocks of a schedule, about, from which on blocks become larger.
BLOCKS = 1_000_000
BUCKET, GROUP = 500, 1000
#: Rows of a table that is broadcast; a larger one is joined by a shuffle.
SMALL = 200_000


def whole(weights: list) -> list[int]:
    """Whole numbers in the exact ratio of positive weights, which are read as they are written."""
    exact = [Fraction(str(w)) for w in weights]
    common = math.lcm(*(w.denominator for w in exact))
    numbers = [int(w * common) for w in exact]
    divisor = math.gcd(*numbers)
    return [n // divisor for n in numbers]


class Ideal:
    """The ideal mixture of sources of n blocks each at whole weights a: all flow at their weights until they run out.

    Virtual time v is that in which source s has flowed a[s] * v blocks; it runs out at n[s] / a[s].
    """

    def __init__(self, n: list[int], a: list[int]):
        order = sorted(range(len(n)), key=lambda s: Fraction(n[s], a[s]))
        self.n, self.a = [n[s] for s in order], [a[s] for s in order]
        self.ends = [x / y for x, y in zip(self.n, self.a, strict=True)]
        self.gone = [0, *np.cumsum(np.array(self.n, object)).tolist()]
        self.rate = [sum(self.a) - w for w in (0, *np.cumsum(np.array(self.a, object)).tolist())]

    def time(self, k: int, a: int) -> tuple[int, int, int]:
        """When a source of weight a has flowed k blocks, as (whole, numerator, denominator), after how many sources ran out."""
        j = bisect_left(self.ends, k / a)  # nearly; then exactly
        while j < len(self.n) and self.n[j] * a < k * self.a[j]:
            j += 1
        while j and self.n[j - 1] * a >= k * self.a[j - 1]:
            j -= 1
        return self.gone[j], self.rate[j] * k, j


def edf(n: list[int], a: list[int]) -> tuple[list[int], list[int]]:
    """The source of each slot, and how many sources had run out in the ideal mixture when its block was released."""
    ideal, done, waiting, ready = Ideal(n, a), [0] * len(n), [], []
    slots, phases = [], []

    def wait(s: int, soonest: int) -> None:
        base, part, phase = ideal.time(done[s], a[s])
        heapq.heappush(waiting, (max(soonest, base + part // a[s]), s, phase))

    for s in range(len(n)):
        if n[s]:
            wait(s, 0)
    for t in range(sum(n)):
        while waiting and waiting[0][0] <= t:
            _, s, phase = heapq.heappop(waiting)
            base, part, _ = ideal.time(done[s] + 1, a[s])
            heapq.heappush(ready, (base - (-part // a[s]), s, phase))
        _, s, phase = heapq.heappop(ready)
        slots.append(s)
        phases.append(phase)
        done[s] += 1
        if done[s] < n[s]:
            wait(s, t + 1)
    return slots, phases


def plan(blocks: list[int], weights: list) -> pa.Table:
    """no, source_block, slot and phase of every block: sources of infinite weight first, then weighted ones, then those of no weight."""
    source, phase = [], []
    of_rank = [0 if w == math.inf else 1 if w > 0 else 2 for w in weights]
    for rank in range(3):
        chosen = [s for s, r in enumerate(of_rank) if r == rank]
        if chosen:
            a = whole([weights[s] for s in chosen]) if rank == 1 else [1] * len(chosen)
            slots, gone = edf([blocks[s] for s in chosen], a)
            first = max(phase, default=-1) + 1
            source += [chosen[s] for s in slots]
            phase += [first + g for g in gone]
    source = np.array(source, np.int64)
    order = np.argsort(source, kind="stable")
    number = np.empty(len(source), np.int64)
    number[order] = np.arange(len(source)) - np.searchsorted(source[order], source[order])
    return pa.table({"no": pa.array(source, pa.int32()), "source_block": number, "slot": np.arange(len(source)), "phase": pa.array(phase, pa.int32())})


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL else df


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, doc_id: str = "doc_id", source: str = "source", block: int = BLOCK) -> DataFrame:
    """docs with source_block, slot (of the block in the whole schedule), place (in the block) and phase."""
    spark = docs.sparkSession
    added = ("source_block", "slot", "place", "phase")
    docs = docs.drop(*added)
    hashed, bucket, group, base, before, rank, no, its, its_block = free_names(docs, "hashed", "bucket", "group", "base", "before", "rank", "no", "its", "its_block")
    counts = sorted(((r[0], r[1]) for r in docs.groupBy(source).agg(F.count("*").alias("n")).collect()), key=lambda r: (r[0] is not None, r[0]))
    n_docs, weights = sum(c for _, c in counts), {s: w for s, w in (weights or {}).items() if w == w}  # without NaN
    block = max(block, -(-n_docs // BLOCKS))
    default = min((w for w in weights.values() if w != math.inf), default=1.0)
    slots = plan([-(-c // block) for _, c in counts], [weights.get(s, default) for s, _ in counts])
    buckets = max(1, -(-n_docs // BUCKET))
    named = spark.createDataFrame([(s, k) for k, (s, _) in enumerate(counts)], f"`{its}` {docs.schema[source].dataType.simpleString()}, `{no}` int")
    keyed = docs.withColumn(hashed, F.xxhash64(F.col(doc_id), F.lit("mix"))).withColumn(bucket, F.pmod(F.col(hashed), F.lit(buckets)))
    keyed = keyed.join(_small(named, len(counts)), F.col(source).eqNullSafe(F.col(its))).drop(its)
    held = keyed.groupBy(no, bucket).agg(F.count("*").alias(base)).withColumn(group, F.floor(F.col(bucket) / GROUP))
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = held.groupBy(no, group).agg(F.sum(base).alias(before))
    groups = groups.select(no, group, F.coalesce(F.sum(before).over(earlier(no, group)), F.lit(0)).alias(before))
    bases = held.select(no, group, bucket, F.coalesce(F.sum(base).over(earlier(no, group, bucket)), F.lit(0)).alias(base))
    bases = bases.join(groups, [no, group]).select(no, bucket, (F.col(base) + F.col(before)).alias(base))
    order = Window.partitionBy(no, bucket).orderBy(hashed, doc_id)
    ranked = keyed.withColumn(rank, F.row_number().over(order) - 1).join(_small(bases, buckets * len(counts)), [no, bucket])
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(base))
    ranked = ranked.withColumn(its_block, F.floor(F.col(rank) / block).cast("long")).withColumn("place", (F.col(rank) % block).cast("int"))
    timed = spark.createDataFrame(slots).select(F.col("no").alias(no), F.col("source_block").alias(its_block), "slot", "phase")
    out = ranked.join(_small(timed, slots.num_rows), [no, its_block]).withColumnRenamed(its_block, "source_block")
    return out.select(*docs.columns, "source_block", "place", "slot", "phase")


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows range-partitioned and sorted into the order of the schedule, which files written from them keep."""
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")
