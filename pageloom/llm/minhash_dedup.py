"""Near-duplicate documents by MinHash with tensored banding.

A document is its set of distinct 5-word shingles, hashed to 64 bits. Instead of one fresh group of
hashes for each of the L tables, two collections of SIDE pieces are computed, each piece made of PIECE
minhashes, and table (i, j) is keyed by piece i of the first with piece j of the second: SIDE * SIDE
tables from 2 * SIDE * PIECE minhashes, about the square root of what independent tables need. Two sets
of similarity s meet unless they miss on a whole side, with probability of 2 * (1 - s**PIECE) ** SIDE at
most: 5e-4 at s = 0.75, 7e-5 at 0.8, 5e-6 at 0.85.

Equal sets are one node from the start. A table's bucket links its members to its smallest node, which
is a row for each member and not one for each pair; nodes that such candidate links connect are a family.
Links are then confirmed on full sets:

* Each node meets one smaller node first, the one it shares most tables with. These stars are as many as nodes,
  and what they confirm, a forest, puts nearly all members of a true group into one cluster. A star of any size is split into units.
* From here on only candidate links between different clusters count, and families that are one cluster are finished. In the others, only members outside the largest cluster are
  compared: with each other and with that cluster, in blocks of about BLOCK shingles and NODES sets, each pair of
  blocks a unit of its own. A unit yields a spanning forest of its links, never its pairs.
* Families larger than one block are refined before that. Two sets of similarity 0.75 must share one of the rarest
  quarter of their shingles, and one more, by any order of shingles; taken in the order of their frequency in
  the family, the shingles of common boilerplate come last, and sets that only boilerplate has brought together
  share none. Only members that share such a shingle with another cluster are compared.

Families and components are joined as tables, without collecting any of them. As whole families are compared, two
similar sets also meet if they collide with a common third one.

Defined results: a null, empty or blank text has an empty set, links with nothing and is kept. Rows
that repeat a doc_id with an equal set are one document; different sets under one doc_id are linked each
on its own. A row without doc_id takes part in links; its component_id is
the smallest doc_id of its component, or null where there is none, and then it is kept. Empty tables
give empty results. Other columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.common import discard, free_names, give_back, in_turn, mix64, settle, windows
from pageloom.llm.components import connected_components, roots

WIDTH = 5
SIDE = 10
PIECE = 2
SIMILARITY = 75  # in hundredths
#: Shingles, and sets, in a block of a family at most, about.
BLOCK = 400_000
NODES = 1_000
#: Sets that are made at one time.
SLICE = 512
#: Columns multiplied at once.
COLUMNS = 2048


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; the whole sequence if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    run = min(width, len(words))
    found = windows(ids, run)
    return np.unique(found if run == width else mix64(found + np.uint64(run)))


def _multipliers(seed: int, n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)


FIRST, SECOND = _multipliers(1, SIDE * PIECE), _multipliers(2, SIDE * PIECE)


def side(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The pieces of one collection: PIECE minhashes of 32 bits, put together into 64."""
    lows = np.empty(len(multipliers), np.uint64)
    for k, m in enumerate(multipliers):
        lows[k] = ((shingles * m) >> np.uint64(32)).min()
    pieces = lows.reshape(-1, PIECE)
    out = pieces[:, 0]
    for k in range(1, PIECE):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + pieces[:, k])
    return out.view(np.int64)


LONGS = T.ArrayType(T.LongType())
#: Types are objects, not DDL: executors import this module, and have no session to parse with.
SIGNATURE = T.StructType([T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("first", LONGS), T.StructField("second", LONGS)])


@F.arrow_udf(SIGNATURE)
def signature(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Size and digest of the set, and its two collections of pieces (null for an empty set)."""
    yield from in_turn(signatures)(texts)


def signatures(texts: pa.Array) -> pa.StructArray:
    n, digests, first, second = [], [], [], []
    for t in texts:
        s = shingle_set(t.as_py())
        n.append(len(s))
        digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
        mixed = mix64(s)
        first.append(side(mixed, FIRST) if len(s) else None)
        second.append(side(mixed, SECOND) if len(s) else None)
    longs = pa.list_(pa.int64())
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(first, longs), pa.array(second, longs)], names=["n", "digest", "first", "second"])


def with_members(rows: DataFrame, text: str) -> DataFrame:
    """rows with the shingle set of a text in its place, as an array members; few sets are in memory at one time."""
    at, others = rows.columns.index(text), [c for c in rows.columns if c != text]

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                sets = [shingle_set(t.as_py()).view(np.int64) for t in part.column(at)]
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                members = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets), pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), members], names=[*others, "members"])
        give_back()

    schema = T.StructType([*(rows.schema[c] for c in others), T.StructField("members", LONGS)])
    return rows.mapInArrow(sets_of, schema)


def table_keys(nodes: DataFrame) -> DataFrame:
    """(key, node): a row for each node and table."""
    cells = F.flatten(F.transform("first", lambda a, i: F.transform("second", lambda b, j: F.xxhash64(a, b, i * SIDE + j))))
    return nodes.select(F.explode(cells).alias("key"), "node")


def links_between(sizes: np.ndarray, values: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets: (row, row) pairs of similar sets.

    sizes are those of the sets, values their members one set after another.
    """
    rows = np.repeat(np.arange(len(sizes)), sizes)
    kept = np.ones(len(sizes), bool)
    _, columns = np.unique(values, return_inverse=True)
    while True:  # a set needs SIMILARITY hundredths of its members in other sets
        met = np.bincount(columns, minlength=1) >= 2
        shared = np.bincount(rows[met[columns]], minlength=len(sizes))
        stay = kept & (100 * shared >= SIMILARITY * sizes)
        if not stay.any():
            return []
        if stay.sum() == kept.sum():
            break
        kept = stay
        inside = kept[rows]
        rows, columns = rows[inside], columns[inside]
    inside = met[columns]
    rows, columns = rows[inside], columns[inside]
    at = np.flatnonzero(kept)
    place = np.full(len(sizes), -1)
    place[at] = np.arange(len(at))
    rows = place[rows]
    _, columns = np.unique(columns, return_inverse=True)
    common = np.zeros((len(at), len(at)), np.float32)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for low in range(0, int(columns[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(columns, (low, low + COLUMNS))
        part = np.zeros((len(at), min(COLUMNS, int(columns[-1]) + 1 - low)), np.float32)
        part[rows[a:b], columns[a:b] - low] = 1
        common += part @ part.T
    n = sizes[at]
    linked = np.empty(common.shape, bool)
    for low in range(0, len(at), 256):
        shared = np.rint(common[low : low + 256]).astype(np.int64)
        linked[low : low + 256] = 100 * shared >= SIMILARITY * (n[low : low + 256, None] + n[None, :] - shared)
    return forest(at, linked)


def forest(at: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that span each component of a symmetric matrix, by a search from its unseen rows."""
    unseen, out = np.ones(len(at), bool), []
    for root in range(len(at)):
        if not unseen[root]:
            continue
        unseen[root] = False
        front = [root]
        while front:
            k = front.pop()
            new = np.flatnonzero(linked[k] & unseen)
            unseen[new] = False
            out += [(int(at[k]), int(at[j])) for j in new]
            front += new.tolist()
    return out


def confirm(unit: pa.Table) -> pa.Table:
    members = unit.column("members").combine_chunks()
    sizes = np.diff(members.offsets.to_numpy())
    node = unit.column("node").to_numpy()
    found = links_between(sizes, members.flatten().to_numpy())
    if members.offsets[-1].as_py() > SLICE * 100:
        give_back()
    u, v = (node[[f[k] for f in found]] if found else np.zeros(0, np.int64) for k in (0, 1))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def text_mark(text: str) -> Column:
    """Tells the texts of a doc_id, or of rows without one, apart."""
    return F.unhex(F.sha2(text, 256))


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, mark, n, digest), sets (digest, component), and components with their least row (doc_id, mark), those without doc_id last."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("mark", text_mark("text"))
    signed = settle(plain.select("doc_id", "mark", signature("text").alias("s")).select("doc_id", "mark", "s.*"), "signatures")
    # one node for equal sets; its text is that of its least row
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    groups = signed.where("n > 0").groupBy("digest").agg(F.min(row).alias("least"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("second").alias("second"))
    # the numbers hold from here on, as the table is written and read again
    groups = settle(groups.withColumn("node", F.monotonically_increasing_id()), "nodes")
    labels = settle(linked_components(groups, plain), "components")
    named = groups.select("digest", "node", "least").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    leasts = named.groupBy("component").agg(F.min("least").alias("least")).select("component", "least.doc_id", "least.mark")
    return signed.select("doc_id", "mark", "n", "digest"), named.select("digest", "component"), leasts


def find_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs."""
    signed, named, leasts = grouped(docs, doc_id, text)
    members = named.join(leasts.select("component", F.col("doc_id").alias("component_id")), "component").select("digest", "component_id")
    out = signed.select("doc_id", "n", "digest").join(members, "digest", "left")
    out = out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def candidate_links(nodes: DataFrame) -> DataFrame:
    """(u, v, shared): each node with the smallest node of each bucket that holds both, and how many tables they share so.

    Spark takes the exploded keys to be as small as the table of nodes, which is why their join is named: they must not be broadcast.
    """
    keys = table_keys(nodes)
    full = keys.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v < last").select("key", "v")
    return keys.join(full.hint("merge"), "key").where("node != v").groupBy(F.col("node").alias("u"), "v").agg(F.count("*").alias("shared"))


def blocks_of(n: str) -> Column:
    """How many blocks sets with these numbers of shingles fill."""
    return F.ceil(F.greatest(F.sum(n) / BLOCK, F.count("*") / NODES)).cast("int")


def star_links(best: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (u, v) among best(u, v, n) that hold for the full sets(node, n, members); n is the size of u's set."""
    parts = best.groupBy("v").agg(blocks_of("n").alias("parts"))
    as_member = best.join(parts, "v").select(F.col("u").alias("node"), "v", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("centre"))
    as_centre = parts.select(F.col("v").alias("node"), "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("centre"))
    units = sets.select("node", "members").join(as_member.union(as_centre), "node")
    return units.groupBy("v", "part").applyInArrow(confirm_star, "u bigint, v bigint")


def confirm_star(unit: pa.Table) -> pa.Table:
    members = unit.column("members").combine_chunks()
    sizes, values = np.diff(members.offsets.to_numpy()), members.flatten().to_numpy()
    node, centre = unit.column("node").to_numpy(), int(np.flatnonzero(unit.column("centre").to_numpy())[0])
    rows = np.repeat(np.arange(len(sizes)), sizes)
    own = np.sort(values[rows == centre])
    hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
    shared = np.bincount(rows[hit], minlength=len(sizes))
    linked = 100 * shared >= SIMILARITY * (sizes + len(own) - shared)
    linked[centre] = False
    if len(values) > SLICE * 100:
        give_back()
    return pa.table({"u": pa.array(node[linked], pa.int64()), "v": pa.array(np.full(int(linked.sum()), node[centre]), pa.int64())})


def unfinished(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """(node, family, cluster) of the members of clusters(node, component) that candidate links connect with other clusters.

    Clusters are named by their roots, which have no row of their own.
    """
    of = lambda end: clusters.select(F.col("node").alias(end), F.col("component").alias(f"{end}_cluster"))
    met = links.join(of("u"), "u", "left").join(of("v"), "v", "left")
    between = met.select(F.coalesce("u_cluster", "u").alias("u"), F.coalesce("v_cluster", "v").alias("v")).where("u != v").distinct()
    families = connected_components(settle(between, "between")).select(F.col("node").alias("cluster"), F.col("component").alias("family"))
    members = clusters.select("node", F.col("component").alias("cluster")).join(families, "cluster")
    return members.select("node", "family", "cluster").union(families.select(F.col("cluster").alias("node"), "family", "cluster"))


def with_largest(placed: DataFrame) -> DataFrame:
    """placed(node, family, cluster), without families of one cluster, and whether the cluster is the largest of its family."""
    held = placed.groupBy("family", "cluster").agg(F.count("*").alias("held"))
    largest = held.groupBy("family").agg(F.count("*").alias("clusters"), F.max(F.struct("held", "cluster")).alias("largest")).where("clusters > 1")
    met = placed.join(largest.select("family", F.col("largest.cluster").alias("most")), "family")
    return met.select("node", "family", "cluster", (F.col("cluster") == F.col("most")).alias("inside"))


def refined(large: DataFrame, sets: DataFrame) -> DataFrame:
    """large(node, family, cluster) dealt into families whose members share a shingle of their rarest ones with another cluster."""
    shingles = sets.join(large, "node").select("node", "family", "cluster", "n", F.explode("members").alias("shingle"))
    common = shingles.groupBy("family", "shingle").agg(F.count("*").alias("held")).where("held > 1")
    # shingles that no other member has come first, and need no row of their own: they only take places
    met = shingles.join(common.hint("merge"), ["family", "shingle"])  # neither may be broadcast, however small Spark takes exploded sets to be
    places = met.groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("kept"), F.first("family").alias("family"), F.first("cluster").alias("cluster"))
    prefix = F.col("n") - F.ceil(F.col("n") * SIMILARITY / 100) + 1 - (F.col("n") - F.size("kept"))
    rare = places.where(prefix > 0).select("node", "family", "cluster", F.explode(F.slice("kept", F.lit(1), prefix.cast("int"))).alias("s"))
    rare = settle(rare.select("node", "family", "cluster", F.col("s.shingle").alias("shingle")), "rare")
    groups = rare.groupBy("family", "shingle").agg(F.min("node").alias("v"), F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low < high")
    links = rare.join(groups, ["family", "shingle"]).where("node != v").select(F.col("node").alias("u"), "v").distinct()
    links = settle(links, "rare_links")
    parts = connected_components(links)
    placed = settle(large.select("node", "cluster").join(parts.select("node", F.col("component").alias("family")), "node").select("node", "family", "cluster"), "placed")
    discard(rare, links, parts)
    return with_largest(placed)


def block_links(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) that span what similar pairs connect in placed(node, family, cluster, inside, n), pairs inside a largest cluster left out."""
    sizes = placed.groupBy("family").agg(
        blocks_of("n").alias("blocks"),
        F.ceil(2 * F.greatest(F.sum(F.when(~F.col("inside"), F.col("n"))) / BLOCK, F.count_if(~F.col("inside")) / NODES)).cast("int").alias("outer"),
        F.ceil(2 * F.greatest(F.sum(F.when(F.col("inside"), F.col("n"))) / BLOCK, F.count_if("inside") / NODES)).cast("int").alias("inner"),
    )
    dealt = placed.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    pair = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    # a block of outer members meets the other outer blocks, and those of the largest cluster, which are numbered after them
    outer = F.transform(numbers(F.col("outer")), lambda k: pair(F.least("block", k), F.greatest("block", k)))
    outer = F.filter(outer, lambda p: (F.col("outer") == 1) | (p["low"] != p["high"]))
    crossed = F.transform(numbers(F.col("inner")), lambda k: pair(F.col("block"), F.col("outer") + k))
    inner = F.transform(numbers(F.col("outer")), lambda k: pair(k, F.col("outer") + F.col("block")))
    units = F.when(F.col("blocks") == 1, F.array(pair(F.lit(0), F.lit(0)))).when(F.col("inside"), inner).otherwise(F.concat(outer, crossed))
    dealt = settle(dealt.select("node", "family", units.alias("units")), "dealt")
    rows = sets.select("node", "members").join(dealt, "node")
    rows = rows.select("family", F.explode("units").alias("unit"), "node", "members").select("family", "unit.low", "unit.high", "node", "members")
    found = settle(rows.groupBy("family", "low", "high").applyInArrow(confirm, "u bigint, v bigint"), "block_links")
    discard(dealt)
    return found


def linked_components(nodes: DataFrame, plain: DataFrame) -> DataFrame:
    """(node, component) of the nodes that chains of similar sets connect; one node of each component may have no row, and names it."""
    links = settle(candidate_links(nodes.select("node", "first", "second")), "candidates")
    met = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    at = met.join(nodes.select("node", F.col("least.doc_id").alias("least_id"), F.col("least.mark").alias("least_mark"), "n"), "node")
    least = plain["doc_id"].eqNullSafe(F.col("least_id")) & (plain["mark"] == F.col("least_mark"))
    texts = plain.join(at, least).dropDuplicates(["node"]).select("node", "n", "text")
    sets = settle(with_members(texts, "text"), "sets")
    sizes = sets.select("node", "n")
    best = links.groupBy("u").agg(F.max(F.struct("shared", (-F.col("v")).alias("v"))).alias("best")).select("u", (-F.col("best.v")).alias("v"))
    best = settle(best.join(sizes.select(F.col("node").alias("u"), "n"), "u"), "best")
    clusters = roots(star_links(best, sets).select(F.col("u").alias("node"), F.col("v").alias("component")))
    placed = settle(unfinished(links, clusters), "placed")
    rest = settle(with_largest(placed).join(sizes, "node"), "unfinished")
    discard(links, best, placed)
    merged = None
    if not rest.isEmpty():
        blocks = rest.groupBy("family").agg(blocks_of("n").alias("blocks"))
        large = settle(rest.join(blocks.where("blocks > 1"), "family", "left_semi"), "large")
        small = rest.join(blocks.where("blocks = 1"), "family", "left_semi")
        of = lambda end: rest.select(F.col("node").alias(end), F.col("cluster").alias(f"{end}_cluster"))
        compared = small if large.isEmpty() else small.unionByName(settle(refined(large.drop("n"), sets).join(sizes, "node"), "refined"))
        found = block_links(compared, sets)
        between = settle(found.join(of("u"), "u").join(of("v"), "v").select(F.col("u_cluster").alias("u"), F.col("v_cluster").alias("v")).where("u != v").distinct(), "confirmed")
        merged = connected_components(between)
        discard(large, found, between)
    discard(sets, rest)
    if merged is None:
        return clusters
    of_cluster = merged.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return clusters.join(of_cluster, "component", "left").select("node", F.coalesce("whole", "component").alias("component")).union(merged.select("node", "component"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates in docs(doc_id, text, ...), columns unchanged.

    It is one row, of the smallest doc_id; rows without doc_id stay only where their group has no doc_id
    at all. Rows with an empty set stay once for each doc_id, and without one, once for each text.
    """
    signed, _, leasts = grouped(docs)
    mark, its_id, its_mark = free_names(docs, "mark", "its_id", "its_mark")
    texts = F.when(F.col("doc_id").isNull(), F.col("mark")).alias("own")
    empty = signed.where("n = 0").groupBy("doc_id", texts).agg(F.min(F.struct("mark")).alias("least")).select("doc_id", "least.mark")
    stay = leasts.select("doc_id", "mark").union(empty).toDF(its_id, its_mark)
    keyed = docs.withColumn(mark, text_mark("text"))
    met = keyed.join(stay, keyed["doc_id"].eqNullSafe(F.col(its_id)) & keyed[mark].eqNullSafe(F.col(its_mark)), "left_semi")
    return met.dropDuplicates(["doc_id", mark]).drop(mark)
