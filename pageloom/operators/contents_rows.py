"""The rows of contents pages, from the places of their lines.

Spark says of each line what it is: a heading, a whole row (title and page), a page alone, an open line (a chapter or appendices,
which may have no page), or text. Then, page by page, what belongs together is found by cost: pages and titles pair up, cheapest pairs
first, and the lines that are left join the entry that they are closest to, closest ones first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.functions.text import PAGE, contents_row, contents_text, match_key
from pageloom.operators.sequential import clusters, together

#: Rows of an outline that are first-level, and those of them that may come without a page (fixed values).
TOP = r"(?i)^(?:(?:chapter|part)\s+(?:\d+|[ivxlcdm]+)\b|\d+[.)]\s+.+|preface|foreword|terms?\s+of\s+reference|scope\s+of\s+(?:the\s+)?report|glossary(?:\s+of\b.*)?|abbreviations?|acronyms?|executive\s+summary|recommendations?|contributors?|acknowledg(?:e)?ments?|appendices|bibliography|references|index|list\s+of\s+(?:figures|tables|recommendations)|about\s+the\s+commission)\s*(?::.*)?$"
UNPAGED = r"(?i)^(?:(?:chapter|part)\s+(?:\d+|[ivxlcdm]+)\b.*|appendices)$"
HEADING = r"(?i)^(?:table\s+of\s+)?contents$"
PAGE_ALONE, PAGE_AT_END = rf"(?i)^{PAGE}$", rf"(?i)\s{PAGE}$"
#: Margins of a page whose lines don't count, and the longest title (fixed values).
MARGIN_ABOVE, MARGIN_BELOW, LONGEST = 42.0, 45.0, 300
#: A page and its title: a point of height costs as much as so many points of distance; how far their middles may be apart, in points or in heights of
#: the page's number; how much of a title's edge may reach over; how near to the next column it may begin; and where a column of leading numbers may be (fixed values).
HEIGHT_COST, LEVEL, LEVEL_SHARE, OVERLAP, COLUMN_GAP, LEADING = 20.0, 3.5, 0.48, 3.0, 8.0, 0.28
#: Text that begins with a number of its own goes on with the row above only if nothing below takes it.
LATER = 1000.0


class Reach(NamedTuple):
    """Which lines an entry takes: how many above and below, the gaps that they may have, and how far their left edges may be off."""

    above: int
    least_above: float
    most_above: float
    aside_above: float
    below: int
    least_below: float
    share_below: float
    aside_below: float


#: By what an entry begins with (fixed values).
REACH = {"row": Reach(4, -2.0, 3.5, 60.0, 2, -2.0, 0.55, 28.0), "pair": Reach(4, -1.0, 2.0, 60.0, 2, -2.0, 0.55, 28.0), "open": Reach(0, 0.0, 0.0, 0.0, 2, -1.0, 0.55, 22.0)}


class Line(NamedTuple):
    kind: str
    title: str
    printed: str | None
    starts: bool  # with a number of its own
    ends: bool  # with a page
    prominent: bool
    l: float  # noqa: E741
    t: float
    r: float
    b: float

    @property
    def middle(self) -> float:
        return (self.t + self.b) / 2


@dataclass
class Entry:
    """Lines of the title from the top, the one that the entry began with, and the page that stands apart."""

    words: list[int]
    core: int
    reach: Reach
    number: int | None = None


def pairs(lines: list[Line], width: float) -> list[tuple[float, int, int]]:
    """(cost, number, title) of all pages that stand apart with the titles at their height and in their column."""
    numbers = [k for k, x in enumerate(lines) if x.kind == "page"]
    if not numbers:
        return []
    slack = max(16.0, 0.08 * width)
    every = clusters([lines[k].l for k in numbers], slack)
    columns = [c for c in every if sum(abs(lines[k].l - c) <= slack for k in numbers) >= 3] or every
    edges = [0.0, *columns, width]
    leading = columns[0] < LEADING * width
    out = []
    for k in numbers:
        n = lines[k]
        nearest = 1 + min(range(len(columns)), key=lambda c: abs(columns[c] - n.l))
        for j, x in enumerate(lines):
            off = abs(x.middle - n.middle)
            if x.kind not in ("text", "open") or off > max(LEVEL, LEVEL_SHARE * (n.b - n.t)):
                continue
            away = x.l - n.r if leading else n.l - x.r
            inside = x.l <= edges[nearest + 1] - COLUMN_GAP if leading else x.l >= edges[nearest - 1] + COLUMN_GAP
            if away >= -OVERLAP and inside:
                out.append((HEIGHT_COST * off + abs(away), k, j))
    return out


def cheapest(costs: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """Pairs in the order of their costs, each side once."""
    seen: set[tuple[str, int]] = set()
    out = []
    for _, k, j in sorted(costs):
        if ("page", k) not in seen and ("title", j) not in seen:
            seen |= {("page", k), ("title", j)}
            out.append((k, j))
    return out


def gap_to(entry: Entry, lines: list[Line], k: int, above: bool) -> float | None:
    """The gap between an entry and a line above or below it, or null if it is out of reach."""
    x, reach, core = lines[k], entry.reach, entry.words.index(entry.core)
    if above:
        gap = lines[entry.words[0]].t - x.b
        fits = core < reach.above and reach.least_above <= gap <= reach.most_above and abs(x.l - lines[entry.core].l) <= reach.aside_above
    else:
        gap = x.t - lines[entry.words[-1]].b
        fits = len(entry.words) - 1 - core < reach.below and x.kind == "text" and not x.ends and reach.least_below <= gap <= reach.share_below * max(5.0, x.b - x.t) and abs(x.l - lines[entry.words[0]].l) <= reach.aside_below
    return gap if fits else None


def join_lines(entries: list[Entry], lines: list[Line], free: set[int]) -> None:
    """Free lines join entries, the smallest gap first; of equal gaps a line goes with the entry above it."""
    queue: list[tuple[float, bool, int, int]] = []

    def cost(e: int, k: int, above: bool) -> float | None:
        gap = gap_to(entries[e], lines, k, above)
        return None if gap is None else gap + LATER * (lines[k].starts and not above)

    def offer(e: int, above: bool) -> None:
        for k in free:
            if (c := cost(e, k, above)) is not None:
                heapq.heappush(queue, (c, above, k, e))

    for e in range(len(entries)):
        offer(e, True)
        offer(e, False)
    while queue:
        c, above, k, e = heapq.heappop(queue)
        if k in free and cost(e, k, above) == c:  # else something has come between since
            free.discard(k)
            entries[e].words.insert(0 if above else len(entries[e].words), k)
            offer(e, above)


def entries_of(lines: list[Line], width: float) -> list[tuple]:
    """(title, printed, l, t, r, b, indent, prominent) of the entries of a page, column by column."""
    entries = [Entry([k], k, REACH["row"]) for k, x in enumerate(lines) if x.kind == "row"]
    entries += [Entry([j], j, REACH["pair"], k) for k, j in cheapest(pairs(lines, width))]
    free = {k for k, x in enumerate(lines) if x.kind in ("text", "open")} - {e.core for e in entries}
    join_lines(entries, lines, free)
    opened = [Entry([k], k, REACH["open"]) for k in sorted(free) if lines[k].kind == "open"]
    join_lines(opened, lines, free - {e.core for e in opened})
    out = []
    for e in entries + opened:
        title = " ".join(lines[k].title for k in e.words).strip(" \t.·•")
        printed = lines[e.core].printed if e.number is None else lines[e.number].title
        covered = [lines[k] for k in (*e.words, *([] if e.number is None else [e.number]))]
        box = (min(x.l for x in covered), min(x.t for x in covered), max(x.r for x in covered), max(x.b for x in covered))
        if title and (e.number is None or len(title) <= LONGEST):
            out.append((title, printed, *box, lines[e.words[0]].l, lines[e.words[0]].prominent))
    columns = clusters([x[2] for x in out], max(42.0, 0.2 * width)) or [0.0]
    return sorted(out, key=lambda x: (min(range(len(columns)), key=lambda c: abs(columns[c] - x[2])), x[3], x[2]))


ENTRIES = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("ord", pa.int32()), ("title", pa.string()), ("printed", pa.string()), *((c, pa.float64()) for c in "ltrb"), ("indent", pa.float64()), ("prominent", pa.bool_())])
BATCH = 5_000


def line_kinds(lines: DataFrame) -> DataFrame:
    """lines inside the margins, with what each is, its title and its page."""
    text = contents_text(F.col("text"))
    plain = lines.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), "pos", text.alias("text"), "prominent", *[F.col(c).cast("double").alias(c) for c in (*"ltrb", "page_width", "page_height")])
    plain = plain.where((F.col("text") != "") & ((F.col("t") + F.col("b")) / 2).between(MARGIN_ABOVE, F.col("page_height") - MARGIN_BELOW)).withColumn("row", contents_row(F.col("text")))
    kind = F.when(F.col("text").rlike(HEADING), "heading").when(F.col("text").rlike(PAGE_ALONE), "page").when(F.col("row").isNotNull(), "row").when(F.col("text").rlike(UNPAGED), "open").otherwise("text")
    return plain.select("doc_id", "page", "pos", "page_width", kind.alias("kind"), F.coalesce(F.when(kind == "row", F.col("row.title")), "text").alias("title"), F.when(kind == "row", F.col("row.page")).alias("printed"), F.col("text").rlike(r"^\d+[.)]\s+").alias("starts"), F.col("text").rlike(PAGE_AT_END).alias("ends"), F.coalesce("prominent", F.lit(False)).alias("prominent"), *"ltrb")


def page_entries(lines: DataFrame) -> DataFrame:
    """The contents rows of every page: doc_id, page, ord, title, printed (null for none), l, t, r, b, indent, prominent, level.

    Pages are sorted runs inside hash partitions and are read as one stream a task. Rows with one title, page and place count once.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ENTRIES, strict=True)], schema=ENTRIES)
        for (doc, page), own in groupby(rows(batches), key=lambda x: x[:2]):
            here = list(own)
            found = entries_of([Line(*x[4:]) for x in here], here[0][3] or 0.0)
            out += [(doc, page, k, *x) for k, x in enumerate(found)]
            if len(out) >= BATCH:
                yield pack()
                out = []
        if out:
            yield pack()

    ordered = together(line_kinds(lines), "doc_id", "page").sortWithinPartitions("doc_id", "page", "pos")
    found = ordered.mapInArrow(pages, "doc_id bigint, page int, ord int, title string, printed string, l double, t double, r double, b double, indent double, prominent boolean")
    keyed = found.withColumn("key", match_key(F.col("title"))).where("key <> ''")
    same = Window.partitionBy("doc_id", "page", "key", F.lower(F.coalesce("printed", F.lit(""))), F.bround("l", 0), F.bround("t", 0)).orderBy("ord")
    return keyed.withColumn("n", F.row_number().over(same)).where("n = 1").drop("n", "key").withColumn("level", F.when(F.col("title").rlike(TOP), 1).otherwise(2))
