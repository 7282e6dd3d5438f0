"""Metadata of documents by ranked rules over their lines: lines(doc_id, page, pos, line), pos in reading order.

Rules become rows (rule, value, score), and the best row of a document is its answer. The name of the publishing
organisation is a parameter. Patterns, scores and places are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pageloom.functions import dates
from pageloom.functions.display import file_title
from pageloom.functions.text import clean_line, squeezed, upper_ratio, words_in
from pageloom.operators.review import Thresholds, confidence_band

MONTHS = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
DATE = rf"(?:\d{{1,2}}\s+)?{MONTHS}\s+\d{{4}}"
#: Place -> pattern of its names, and what a line in lower case must hold for it, in order of rank (fixed values).
PLACES = {
    "Victoria, Australia": (r"\bVictoria(?:n)?\b|\(Vic\)", ("victoria", "(vic)")),
    "New South Wales, Australia": (r"\bNew South Wales\b|\(NSW\)", ("new south wales", "(nsw)")),
    "Queensland, Australia": (r"\bQueensland\b|\(Qld\)", ("queensland", "(qld)")),
    "Western Australia, Australia": (r"\bWestern Australia\b|\(WA\)", ("western australia", "(wa)")),
    "South Australia, Australia": (r"\bSouth Australia\b|\(SA\)", ("south australia", "(sa)")),
    "Tasmania, Australia": (r"\bTasmania\b|\(Tas\)", ("tasmania", "(tas)")),
    "Australian Capital Territory, Australia": (r"\bAustralian Capital Territory\b|\(ACT\)", ("australian capital territory", "(act)")),
    "Northern Territory, Australia": (r"\bNorthern Territory\b|\(NT\)", ("northern territory", "(nt)")),
}
#: Date rules in order: pattern, name, confidence (fixed values). The rule `subject` is met by the subject of the file, `file_name` by its name.
DATES = [
    (rf"(?i)\b(?:final\s+)?report\s*[|\-–—:]?\s*({DATE})\b", "cover_report_date", 0.98),
    (rf"(?i)^({DATE})$", "cover_date", 0.96),
    (rf"(?i)©\s*({DATE})\b", "copyright_date", 0.94),
    (rf"(?i)\bpublished[^\n]*?\b({DATE})\b", "publication_date", 0.90),
    (rf"(?i)\b({DATE})\b", "subject", 0.88),
    (r"©[^\n]*?\b((?:19|20)\d{2})\b", "copyright_year", 0.82),
    (r"(?<!\d)((?:19|20)\d{2})(?!\d)", "file_name", 0.45),
]
#: Citation patterns by kind, in order, and what a line must hold for each: in small letters where the pattern takes any case, else as it stands (fixed values).
CITATIONS = {
    "isbn": (r"(?i)\bISBN\s*:?[ \t]*((?:97[89][ \t-]*)?[0-9X](?:[0-9X \t-]{8,20}[0-9X]))", ("isbn",)),
    "series": (r"(?i)\bSeries\s*:\s*(Report[^.;]*)", ("series",)),
    "legislation": (r"\b([A-Z][A-Za-z'’&-]*(?:[ \t]+[A-Z][A-Za-z'’&-]*)*[ \t]+Act[ \t]+(?:19|20)\d{2}(?:[ \t]+\([A-Za-z]{2,4}\))?)", ("Act 1", "Act 2", "Act\t", "Act  ")),
    "case": (r"\b([A-Z][A-Za-z'’.-]+[ \t]+v[ \t]+[A-Z][A-Za-z'’.-]+(?:[ \t]+\[(?:19|20)\d{2}\][ \t]+[A-Z0-9][A-Za-z0-9 ]{1,20}[ \t]+\d+)?)", (" v ", "\tv", " v\t")),
}
#: Words of an author that is an authority (fixed values).
AUTHORITY = r"(?i)\b(?:commission|department|ministry|government)\b"
#: Title rules: method -> (score, confidence).
TITLES = {
    "catalogue": (16.0, 0.98),
    "labelled": (15.0, 0.97),
    "catalogue_report": (15.0, 0.97),
    "after_contact": (13.0, 0.94),
    "document_title": (12.5, 0.96),
    "cover_report": (11.5, 0.91),
    "uppercase": (10.5, 0.88),
}
#: What a library's catalogue puts before a title (a fixed value).
CATALOGUE = r"(?i)^National Library of Australia(?:\s+Cataloguing-in-Publication)?\s*"
MINOR_WORDS = frozenset("a an and as at by for in of on or the to".split())


def holds(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text has any of some words: a test that is cheap enough to stand before a pattern."""
    out = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        out = out | F.contains(text, F.lit(word))
    return out


def by_count(n: Column, one: float, two: float, more: float) -> Column:
    return F.when(n == 1, one).when(n == 2, two).otherwise(more)


def jurisdictions(lines: DataFrame) -> DataFrame:
    """The place that most lines name; of equal ones the one named first."""
    hits = F.filter(F.array(*[F.when(holds(F.lower("line"), words) & F.col("line").rlike("(?i)" + p), F.struct(F.lit(k).alias("rule"), F.lit(v).alias("value"))) for k, (v, (p, words)) in enumerate(PLACES.items())]), lambda x: x.isNotNull())
    votes = lines.select("doc_id", "page", "pos", F.explode(hits).alias("h")).groupBy("doc_id", "h.rule", "h.value").agg(F.count("*").alias("n"), F.min("pos").alias("at"), F.min_by("page", "pos").alias("page"))
    best = votes.groupBy("doc_id").agg(F.min_by(F.struct("value", "page", "n"), F.struct(-F.col("n"), "at", "rule")).alias("b"))
    return best.select("doc_id", "b.value", "b.page", F.col("b.n").alias("matches"), by_count(F.col("b.n"), 0.72, 0.84, 0.93).alias("confidence"))


def publishers(lines: DataFrame, organisation: str, known: DataFrame | None = None) -> DataFrame:
    """Who a line says published the document; else the organisation, if lines name it; else its author in known(doc_id, author), if that is an authority."""
    said = F.regexp_extract("line", r"(?i)\bpublished by\s+(?:the\s+)?([^.;]+)", 1)
    said = F.regexp_replace(said, r"\s+(?:The|This)\s+[A-Z].*$", "")
    said = F.trim(F.regexp_replace(said, r"(?i)\b(?:the commission|copyright|isbn|series)\b.*$", ""))
    named = F.col("line").rlike(r"(?i)\b" + organisation.replace(" ", r"\s+") + r"\b")
    found = lines.select("doc_id", "page", "pos", said.alias("said"), named.alias("named")).where((F.col("said") != "") | F.col("named"))
    each = found.groupBy("doc_id").agg(
        F.min(F.when(F.col("said") != "", F.struct("pos", "said", "page"))).alias("s"),
        F.min(F.when(F.col("named"), F.struct("pos", "page"))).alias("o"),
        F.count_if("named").alias("n"),
    )
    explicit = F.col("s").isNotNull()
    found = each.select(
        "doc_id",
        F.when(explicit, F.col("s.said")).otherwise(organisation).alias("value"),
        F.when(explicit, F.col("s.page")).otherwise(F.col("o.page")).alias("page"),
        F.when(explicit, "published_by").otherwise("organisation_name").alias("method"),
        F.when(explicit, 0.98).otherwise(by_count(F.col("n"), 0.78, 0.84, 0.90)).alias("confidence"),
    )
    if known is None:
        return found
    authors = known.where(F.col("author").rlike(AUTHORITY)).select("doc_id", clean_line(F.col("author")).alias("value"), F.lit(1).cast(found.schema["page"].dataType).alias("page"), F.lit("author").alias("method"), F.lit(0.76).alias("confidence"))
    return found.unionByName(authors.join(found.select("doc_id"), "doc_id", "left_anti"))


def dates_of(lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The date by the first rule that any line of the document meets, at its first line; known(doc_id, subject, file_name) has what isn't in lines."""
    hit = lambda text, k: F.when(F.regexp_extract(text, DATES[k][0], 1) != "", F.struct(F.lit(k).alias("rule"), F.lit(DATES[k][1]).alias("method"), F.lit(DATES[k][2]).alias("confidence"), F.regexp_extract(text, DATES[k][0], 1).alias("raw")))
    of_lines = [hit("line", k) for k, (_, name, _) in enumerate(DATES) if name not in ("subject", "file_name")]
    found = lines.select("doc_id", "page", "pos", F.explode(F.array_compact(F.array(*of_lines))).alias("h"))
    if known is not None:
        at = {name: k for k, (_, name, _) in enumerate(DATES)}
        stem = F.regexp_replace(F.regexp_replace("file_name", r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")
        page = lambda n: F.lit(n).cast(lines.schema["page"].dataType).alias("page")
        pos = F.lit(0).cast(lines.schema["pos"].dataType).alias("pos")
        for text, name, n in ((F.col("subject"), "subject", 1), (stem, "file_name", None)):
            found = found.union(known.select("doc_id", page(n), pos, hit(text, at[name]).alias("h")).where("h is not null"))
    best = found.groupBy("doc_id").agg(F.min_by(F.struct("h.*", "page"), F.struct("h.rule", "pos")).alias("b"))
    return best.select("doc_id", dates.month_year(F.col("b.raw")).alias("value"), "b.page", "b.method", "b.confidence")


def citations(lines: DataFrame, most: int = 50, organisation: str | None = None) -> DataFrame:
    """All different citations of a document in reading order, and a confidence by their number and kinds.

    Of a series only the first in a line counts, and with an organisation only its own reports.
    """

    def matches(no: int, kind: str, pattern: str, words: tuple[str, ...]) -> Column:
        if kind == "series":
            if organisation is not None:
                pattern = rf"(?i)\bSeries\s*:\s*(Report\s*\({organisation}\)(?:\s+\d+)?)"
            found = F.array_compact(F.array(F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))))
        else:
            found = F.regexp_extract_all("line", F.lit(pattern), F.lit(1))
        prefix = {"isbn": "ISBN ", "series": "Series: "}.get(kind, "")
        rows = F.transform(found, lambda v: F.struct(F.lit(no).alias("no"), F.lit(kind).alias("kind"), F.concat(F.lit(prefix), F.trim(v)).alias("value")))
        told = F.lower("line") if pattern.startswith("(?i)") else F.col("line")
        return F.when(holds(told, words), rows).otherwise(F.array().cast("array<struct<no:int,kind:string,value:string>>"))

    rows = [matches(no, kind, *rule) for no, (kind, rule) in enumerate(CITATIONS.items())]
    found = lines.select("doc_id", "page", "pos", F.explode(F.concat(*rows)).alias("c")).select("doc_id", "page", "pos", "c.*")
    value = F.btrim(squeezed(F.col("value")), F.lit(" .;,"))
    value = F.when(F.col("kind") == "legislation", F.regexp_replace(value, r"(?i)^The\s+", "")).otherwise(value)
    found = found.withColumn("value", value).withColumn("key", F.regexp_replace(F.lower("value"), "[^a-z0-9]", ""))
    first = found.where("key <> ''").groupBy("doc_id", "key").agg(F.min_by(F.struct("value", "kind", "pos", "no"), F.struct("pos", "no")).alias("f"))
    listed = F.array_sort(F.collect_list(F.struct("f.pos", "f.no", "f.value")))
    each = first.groupBy("doc_id").agg(listed.alias("all"), F.count("*").alias("found"), F.count_distinct("f.kind").alias("kinds"), F.bool_or(F.col("f.kind").isin("isbn", "series")).alias("coded"))
    score = 0.55 + 0.06 * F.least("found", F.lit(4)) + F.when(F.col("coded"), 0.08).otherwise(0.0) + 0.04 * (F.col("kinds") - 1)
    return each.select("doc_id", F.array_join(F.transform(F.slice("all", 1, most), lambda c: c["value"]), "; ").alias("citations"), "found", F.bround(F.least(F.lit(0.95), score), 2).alias("confidence"))


@F.arrow_udf(T.StringType())
def title_case(titles):
    """Titles in capitals or plain lower case with each word capitalised, but for minor words after the first."""
    import re

    import pyarrow as pa

    out = []
    for t in titles.to_pylist():
        if t is None:
            out.append(None)
            continue
        words = t.split()
        if t.isupper() or re.search(r"[a-z][A-Z]\b", t) or (len(words) <= 12 and t == t.capitalize()):
            words = t.title().split()
        out.append(" ".join(w if k == 0 or w.casefold() not in MINOR_WORDS else w.lower() for k, w in enumerate(words)))
    return pa.array(out, pa.string())


def normal_title(title: Column, organisation: str) -> Column:
    """A title without addresses, publisher, kind of report and dates, its words in title case (fixed patterns)."""
    out = F.regexp_replace(clean_line(title), r"(?i)^.*?(?:https?://|www\.)\S+\s+", "")
    out = F.regexp_replace(out, rf"(?i)\s*/\s*{organisation}\b.*$", "")
    out = F.regexp_replace(out, rf"(?i)\s*[|\-–—:]?\s*(?:final\s+)?report(?:\s+\d+)?(?:\s*[|\-–—]?\s*{MONTHS}\s+\d{{4}})?\s*$", "")
    out = F.regexp_replace(out, rf"(?i)\s+[|\-–—]?\s*{MONTHS}\s+\d{{4}}\s*$", "")
    out = F.btrim(F.regexp_replace(out, r"\s+([:;,.])", "$1"), F.lit(" .:;|-–—"))
    return title_case(F.regexp_replace(out, r"\b([A-Z])\s+([a-z]{3,})\b", "$1$2"))


def valid_title(title: Column) -> Column:
    # what no title says, and how long titles are (fixed values)
    barred = r"(?i)(?:microsoft\s+word|\.doc\b|@|www\.|isbn|copyright|\bthis report\b|\breflects the law\b|\bestablished under\b|\bfinal report view\b)"
    return words_in(title).between(1, 18) & F.length(title).between(5, 180) & ~title.rlike(barred)


def titles(lines: DataFrame, known: DataFrame, organisation: str, first: int = 120) -> DataFrame:
    """The best title of each document: rules over its first lines and its own title (known(doc_id, title), and file_name if it is there) give candidates.

    A candidate gains with the pages that hold it (three count) and on page 1, and loses with its distance from the top. A document
    without any candidate gets the title that its file's name makes.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "pos")
    top = lines.withColumn("position", F.row_number().over(order) - 1).where(F.col("position") < first)
    cut = lambda p, g=1: F.nullif(F.regexp_extract("line", p, g), F.lit(""))
    listed = F.regexp_replace("line", CATALOGUE, "")
    of_listed = lambda p: F.nullif(F.regexp_extract(listed, p, 1), F.lit(""))
    report = of_listed(r"(?i)^(.+?)\s*:\s*(?:final\s+)?report\.?$")
    found = {
        "catalogue": cut(rf"(?i)^(?:title\s*:\s*)?(.+?)(?::\s*(?:final\s+)?report)?\s*/\s*{organisation}\b"),
        "labelled": cut(r"(?i)^title\s*:\s*(.+)$"),
        "catalogue_report": report,
        "cover_report": F.when(report.isNull(), of_listed(r"(?i)^(.+?)\s+(?:final\s+)?report\.?$")),
        "after_contact": cut(r"(?:https?://|www\.)\S+\s+([A-Z][A-Z\s'’&-]{5,})$"),
        "uppercase": F.when((upper_ratio(F.col("line")) >= 0.86) & words_in(F.col("line")).between(2, 16), F.col("line")),
    }
    options = F.filter(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(m).alias("method"), v.alias("raw"))) for m, v in found.items()]), lambda x: x.isNotNull())
    rows = top.select("doc_id", "page", "position", F.explode(options).alias("o")).select("doc_id", "page", "position", "o.*")
    own = known.where(F.coalesce("title", F.lit("")) != "").select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("position"), F.lit("document_title").alias("method"), F.col("title").alias("raw"))
    rows = rows.unionByName(own).withColumn("title", normal_title(F.col("raw"), organisation)).where(valid_title(F.col("title")))
    rows = rows.withColumn("key", F.lower("title"))
    # the lines of a page are one text, as a key has no line end in it: a row a candidate and page, however long the document's pages
    texts = lines.groupBy("doc_id", "page").agg(F.array_join(F.collect_list(F.lower("line")), "\n").alias("l"))
    held = rows.select("doc_id", "key").distinct().join(texts.withColumnRenamed("page", "p"), "doc_id").where(F.contains("l", F.col("key"))).groupBy("doc_id", "key").agg(F.count_distinct("p").alias("matches"))
    score, sure = F.lit(0.0), F.lit(0.86)
    for method, (points, confidence) in TITLES.items():
        score, sure = F.when(F.col("method") == method, points).otherwise(score), F.when(F.col("method") == method, confidence).otherwise(sure)
    rows = rows.join(held, ["doc_id", "key"], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    total = score + F.least(F.lit(3), "matches") * 0.7 + F.when(F.col("page") == 1, 0.5).otherwise(0.0) - F.least(F.col("position"), F.lit(60)) * 0.005
    confidence = F.least(F.lit(0.99), sure + 0.01 * F.greatest(F.lit(0), F.col("matches") - 1))
    best = rows.groupBy("doc_id").agg(F.max_by(F.struct("title", "page", "method", confidence.alias("confidence")), F.struct(total, -F.col("position"), F.col("title"))).alias("b"))
    found = best.select("doc_id", "b.title", "b.page", "b.method", "b.confidence")
    if "file_name" not in known.columns:
        return found
    named = normal_title(file_title(F.col("file_name")), organisation)
    rest = known.join(found.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.nullif(named, F.lit("")).alias("title"), F.lit(None).cast(found.schema["page"].dataType).alias("page"), F.lit("file_name").alias("method"))
    return found.unionByName(rest.withColumn("confidence", F.when(F.col("title").isNotNull(), 0.45).otherwise(0.0)))


def cleaned_info(info: Column) -> Column:
    """The entries of a file's own information that say something, cleaned; a missing map is empty."""
    cleaned = F.transform_values(F.coalesce(info, F.create_map().cast("map<string,string>")), lambda k, v: clean_line(v))
    return F.map_filter(cleaned, lambda k, v: v != "")


#: The fields of a document's metadata, in order.
FIELDS = ("title", "publisher", "published_date", "jurisdiction", "citations")


def metadata_payload(documents: DataFrame, found: DataFrame, at: Thresholds = Thresholds(), pages: tuple[int, int] = (1, 8)) -> DataFrame:
    """(doc_id, metadata, fields): the value of each field, and its band, score, page, evidence and source.

    found(doc_id, field, value, page, method, confidence); documents(doc_id). A field that nothing was found for is empty with a score of 0.
    """
    wanted = documents.select("doc_id", F.explode(F.array(*[F.lit(f) for f in FIELDS])).alias("field"))
    met = wanted.join(found, ["doc_id", "field"], "left")
    value, score = F.trim(F.coalesce("value", F.lit(""))), F.coalesce("confidence", F.lit(0.0))
    method = F.coalesce("method", F.lit("not_found"))
    evidence = F.when(value != "", F.concat(F.lit("Rule-based extraction matched “"), value, F.lit("”."))).otherwise("No value matched the configured metadata rules.")
    where = F.when(F.col("page").isNotNull(), F.concat(F.lit("page "), F.col("page").cast("string"))).otherwise(f"pages {pages[0]}–{pages[1]}")
    info = F.struct(confidence_band(score, at).alias("band"), score.alias("score"), F.coalesce(F.col("page").cast("int"), F.lit(pages[0])).alias("page"), evidence.alias("evidence"), F.concat_ws(" · ", F.lit("Extracted text"), where, method).alias("source"))
    rows = met.select("doc_id", "field", value.alias("value"), info.alias("info"))
    as_map = lambda c: F.map_from_entries(F.collect_list(F.struct("field", c)))
    return rows.groupBy("doc_id").agg(as_map("value").alias("metadata"), as_map("info").alias("fields"))
