"""Benchmark decontamination: training texts are scanned for the word windows of benchmark items.

The distinct windows of all items are one table of (hash, words). A projection turns each text into its words, an explode
into its windows, and a hash join probes the set of window hashes; a match counts only if the words themselves are
equal, which the same join verifies. Up to BROADCAST_BYTES, as measured on the written table, the set is broadcast, so that texts are
scanned where they lie and only hits move; a larger set is joined by a shuffle of the hashes. All steps are
DataFrame expressions.

Words are runs of a-z, 0-9 and characters beyond ASCII, after A-Z are lower-cased. A window is WINDOW words long; an item of fewer
words, but not none, is one window of its own length. A document word inside any occurrence of any window is hit.

Defined results: a null text is an empty one and has no words; nor has an item without text. Rows with the same id and text share one
result, each row once; rows without id are told apart by their text. Items that share an id are one item; an item without an id marks words, but
isn't counted or listed. Empty tables give empty results, and an empty benchmark finds nothing. Further columns pass through
the removals, whatever their names, and are left out of reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import discard, free_names, settle

WINDOW = 10
#: The set of windows is broadcast up to so many bytes: its words and SLOT bytes a window.
BROADCAST_BYTES, SLOT = 64 << 20, 96
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z are lower-cased; and the characters outside words before that.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OUTSIDE = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
KEY = ["doc_id", "digest"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), GAPS), "")


def digest_of(text: Column) -> Column:
    """What tells texts apart; null is like the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def item_windows(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """item, length, gram (words joined by spaces) and hash of the distinct windows of each item."""
    words = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    sized = words.withColumn("length", F.least(F.size("words"), F.lit(window)))
    starts = sized.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)))
    run = F.slice("words", F.col("at"), F.col("length"))
    return starts.select("item", "length", F.array_join(run, " ").alias("gram"), F.xxhash64(run).alias("hash")).distinct()


def find_windows(docs: DataFrame, grams: DataFrame, lengths: list[int], broadcast: bool) -> DataFrame:
    """A row (at = 0) for each document with its n_words, and one for each place (from 1) where a window of grams occurs."""
    docs = docs.select("doc_id", digest_of(F.col("text")).alias("digest"), words_of(F.col("text")).alias("words"))
    run = F.slice("words", F.greatest("at", F.lit(1)), F.col("width"))
    same = (F.col("probe") == F.col("hash")) & (F.array_join(run, " ") == F.col("gram"))
    out = [*KEY, F.size("words").cast("long").alias("n_words"), "at", "length", "gram_id"]

    def exploded(widths: list[int]) -> DataFrame:
        wide = docs.withColumn("width", F.explode(F.array(*map(F.lit, widths))))
        last = F.size("words") - F.col("width") + 1
        places = F.when(F.col("width") == 0, F.array(F.lit(0))).when(last >= 1, F.sequence(F.lit(1), last))
        at = wide.withColumn("at", F.explode(places))
        return at.withColumn("probe", F.when(F.col("at") > 0, F.xxhash64(run)))

    if broadcast:  # one pass; the rows of documents meet nothing, as their probe is null
        return exploded([0, *lengths]).join(F.broadcast(grams), same, "left").where((F.col("at") == 0) | F.col("gram_id").isNotNull()).select(*out)
    alone = docs.select(*KEY, F.size("words").cast("long").alias("n_words"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("long").alias("gram_id"))
    if not lengths:
        return alone
    # only places and hashes are shuffled; the words are fetched again for the few texts that a hash is found in
    places = exploded(lengths).select(*KEY, "at", "width", "probe").hint("shuffle_merge").join(grams.select(F.col("hash").alias("probe")).distinct().hint("shuffle_merge"), "probe")
    likely = places.groupBy(F.col("doc_id").alias("place_id"), F.col("digest").alias("place_digest")).agg(F.collect_set(F.struct("at", "width", "probe")).alias("places"))
    met = docs.join(likely, F.col("doc_id").eqNullSafe(F.col("place_id")) & (F.col("digest") == F.col("place_digest")))
    runs = met.select(*KEY, F.size("words").cast("long").alias("n_words"), F.explode(F.transform("places", lambda p: F.struct(p["at"].alias("at"), p["probe"].alias("probe"), F.array_join(F.slice("words", p["at"], p["width"]), " ").alias("run")))).alias("p")).select(*KEY, "n_words", "p.*")
    return alone.unionByName(runs.join(grams, (F.col("probe") == F.col("hash")) & (F.col("run") == F.col("gram"))).select(*KEY, "n_words", "at", "length", "gram_id"))


def merged_spans(hits: DataFrame) -> DataFrame:
    """For each document with hits: its spans of hit words (start from 1, end behind the last), in order, and n_hit."""
    along = Window.partitionBy(*KEY).orderBy("at", "length")
    reach = F.max(F.col("at") + F.col("length")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    starts = hits.withColumn("starts", F.when(F.col("at") <= reach, 0).otherwise(1))
    spans = starts.withColumn("span", F.sum("starts").over(along.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*KEY, "span").agg(F.min("at").alias("start"), F.max(F.col("at") + F.col("length")).alias("end"))
    return spans.groupBy(*KEY).agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def listed_items(hits: DataFrame, owners: DataFrame) -> DataFrame:
    """For each document with hits: n_items and items_sha256. Documents with the same windows share one list, which is made once."""
    sets = hits.groupBy(*KEY).agg(F.array_sort(F.collect_set("gram_id")).alias("grams")).withColumn("set", F.sha2(F.array_join("grams", ","), 256))
    items = F.array_sort(F.collect_set("item"))
    lists = (
        sets.groupBy("set").agg(F.any_value("grams").alias("grams")).select("set", F.explode("grams").alias("gram_id"))
        .join(owners, "gram_id").select("set", "item").distinct()
        .groupBy("set").agg(F.count("item").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))
    )
    return sets.select(*KEY, "set").join(lists, "set").drop("set")


def contamination(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """For each row of docs: doc_id, digest of its text, n_words, n_hit, n_items, items_sha256, contaminated and spans of hit words."""
    owned = settle(item_windows(benchmark, item, item_text, window), "bench_windows")
    grams = settle(owned.select("gram", "length", "hash").distinct().withColumn("gram_id", F.monotonically_increasing_id()), "bench_grams")
    n_bytes, lengths = grams.agg(F.coalesce(F.sum(F.octet_length("gram") + SLOT), F.lit(0)), F.sort_array(F.collect_set("length"))).first()
    plain = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    found = settle(find_windows(plain, grams, lengths, n_bytes <= broadcast_bytes), "window_hits")
    owners = settle(owned.join(grams, ["gram", "length", "hash"]).where("item is not null").select("gram_id", "item").distinct(), "window_owners")
    discard(owned, grams)
    hits = found.where("at > 0").select(*KEY, "at", "length", "gram_id").distinct()
    none = F.sha2(F.lit(""), 256)
    at_id, at_digest = "hit_id", "hit_digest"
    spans = merged_spans(hits.select(*KEY, "at", "length").distinct()).withColumnsRenamed({"doc_id": at_id, "digest": at_digest})
    lists = listed_items(hits, owners)
    own = lambda a, b: F.col(a).eqNullSafe(F.col(b)) & (F.col("digest") == F.col(at_digest))
    report = spans.join(lists, own("doc_id", at_id), "left").drop(*KEY)
    return (
        found.where("at = 0").select(*KEY, "n_words").join(report, own("doc_id", at_id), "left")
        .select(*KEY, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), "spans")
    )


def without_spans(text: Column, spans: Column) -> Column:
    """text without the words in spans and the characters that follow each of them, up to the next word."""
    pieces = F.regexp_extract_all(text, F.lit(f"[^{OUTSIDE}]+[{OUTSIDE}]*"), F.lit(0))
    lead = F.regexp_extract(text, f"^[{OUTSIDE}]*", 0)
    # what stays before span k begins behind span k - 1; what stays behind the last begins at its end
    before = F.transform(spans, lambda s, k: F.slice(pieces, F.when(k == 0, F.lit(1)).otherwise(F.get(spans, k - 1)["end"]), s["start"] - F.when(k == 0, F.lit(1)).otherwise(F.get(spans, k - 1)["end"])))
    rest = F.slice(pieces, F.element_at(spans, -1)["end"], F.size(pieces))
    return F.concat(lead, F.array_join(F.concat(F.flatten(before), rest), ""))


def _marked(docs: DataFrame, benchmark: DataFrame, doc: str, text: str, **more) -> tuple[DataFrame, str]:
    """docs with the spans of their hit words in a new column, null in clean ones."""
    digest, at_id, at_digest, spans = free_names(docs, "digest", "hit_id", "hit_digest", "spans")
    hit = contamination(docs, benchmark, doc, text, **more).where("contaminated").groupBy(*KEY).agg(F.any_value("spans").alias(spans)).withColumnsRenamed({"doc_id": at_id, "digest": at_digest})
    keyed = docs.withColumn(digest, digest_of(F.col(text)))
    met = keyed.join(hit, F.col(doc).eqNullSafe(F.col(at_id)) & (F.col(digest) == F.col(at_digest)), "left")
    return met.drop(digest, at_id, at_digest), spans


def remove_documents(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The rows of docs that have no hit word, with their columns."""
    met, spans = _marked(docs, benchmark, doc, text, **more)
    return met.where(F.col(spans).isNull()).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """All rows of docs, with their columns; the texts lose the hit words and the gaps behind these."""
    met, spans = _marked(docs, benchmark, doc, text, **more)
    return met.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(without_spans(F.col(text), F.col(spans)))).select(*docs.columns)
