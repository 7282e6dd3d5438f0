"""Text functions on columns: cleaning, keys, slugs, list markers, titles and citations.

Patterns use (?U) where the meaning of white space or word characters is Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A list marker: a number, letter or roman numeral in brackets or before a dot or bracket (a fixed format).
ORDERED = r"^(\((?:\d+|[A-Za-z]|[ivxlcdmIVXLCDM]+)\)|(?:\d+|[A-Za-z]|[ivxlcdmIVXLCDM]+)[.)])\s+"
BULLET = r"^([•\-–*·])\s+"
#: A page number of a contents row: figures, or a well-formed roman numeral (a fixed format).
PAGE = r"(?:\d{1,4}|(?=[ivxlcdm]{1,12}(?:\b|$))m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))"
#: White space between a title and its page, thin and zero-width blanks among it.
GAP = r"[\s\u2002-\u200b\u202f]"
#: The shapes of a contents row, with the groups of title and page.
ROW_SHAPES = [(rf"(?i)^(.+?)\s*\.{{2,}}\s*({PAGE})$", 1, 2), (rf"(?i)^({PAGE}){GAP}+(\D.+)$", 2, 1), (rf"(?i)^(.+?){GAP}{{2,}}({PAGE})$", 1, 2)]
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def squeezed(text: Column) -> Column:
    """Runs of white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    """A text without white space at its ends; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def clean_line(line: Column) -> Column:
    """A line without heading marks, comments and outer pipes."""
    out = F.regexp_replace(F.coalesce(line, F.lit("")), r"^\s{0,3}#{1,6}\s*", "")
    out = F.regexp_replace(F.regexp_replace(out, "<!--.*?-->", ""), r"(?U)\s+", " ")
    return F.btrim(out, F.lit(" |\t"))


def contents_text(text: Column) -> Column:
    """A row of a contents page without controls, soft hyphens and outer dots."""
    out = F.translate(F.coalesce(text, F.lit("")), "­", "")
    out = F.regexp_replace(F.translate(out, "\x07", " "), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.btrim(F.regexp_replace(out, r"(?U)\s+", " "), F.lit(" \t.·•"))


def match_key(text: Column, without_number: bool = False) -> Column:
    """The form in which titles are compared. Lower case stands in for full case folding (ß stays)."""
    out = F.translate(F.replace(F.lower(contents_text(text)), F.lit("&"), F.lit(" and ")), "’‘", "''")
    if without_number:
        out = F.regexp_replace(out, r"^(?:(?:chapter|part|appendix)\s+)?(?:\d+(?:\.\d+)*|[ivxlcdm]+|[a-z])[.):]?\s+", "")
    out = F.regexp_replace(out, r"\bchapter\s+(\d+|[ivxlcdm]+)\b", " ")
    return F.trim(F.regexp_replace(out, r"(?U)[^\w]+", " "))


def token_overlap(first: Column, second: Column) -> Column:
    """Shared words over all words of two keys."""
    a, b = F.array_distinct(F.split(first, " ")), F.array_distinct(F.split(second, " "))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def slug(text: Column, default: str = "section") -> Column:
    out = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(out == "", default).otherwise(out)


def project_slug(title: Column) -> Column:
    """The slug of a title without what follows its colon and without the kind of publication."""
    head = F.regexp_extract(F.trim(title), r"^([^:]*?)\s*(?::|$)", 1)
    head = F.regexp_replace(head, r"(?i)\s+[\-–—]\s+(?:consultation paper|issues paper|final report|report)$", "")
    return slug(head, "publication")


def section_key(title: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(title), r"(?i)^(?:chapter\s+)?\d+\.\s*", "")))


def is_chapter(title: Column) -> Column:
    return title.rlike(r"(?i)^\s*(?:(?:chapter|part)\s+(?:\d+|[ivxlcdm]+)\b|\d+[.)]\s+)")


def list_entry(line: Column) -> Column:
    """struct(text, marker, enumerated, level) of one line, or null; two blanks, or a tab, are one level."""
    flat = F.rtrim(F.replace(F.replace(line, F.lit("\t"), F.lit("  ")), F.lit("|"), F.lit(" ")))
    indent = F.length(flat) - F.length(F.ltrim(flat))
    value = squeezed(flat)
    ordered, bullet = F.regexp_extract(value, ORDERED, 1), F.regexp_extract(value, BULLET, 1)
    marker = F.when(ordered != "", ordered).otherwise(bullet)
    text = F.trim(F.substring(value, F.length(marker) + 1, F.length(value)))
    entry = F.struct(text.alias("text"), marker.alias("marker"), (ordered != "").alias("enumerated"), F.floor(indent / 2).cast("int").alias("level"))
    return F.when(text != "", entry)


def marker_number(marker: Column) -> Column:
    return F.nullif(F.regexp_extract(marker, r"^\(?(\d+)[.)]$", 1), F.lit("")).cast("int")


def published_entry(line: Column) -> Column:
    """struct(text, marker, enumerated, level, value) of a line as publications take it: no level, blanks as they are, and the number of the marker."""
    raw = stripped(F.replace(line, F.lit("\t"), F.lit("  ")))
    ordered, bullet = F.regexp_extract(raw, ORDERED, 1), F.regexp_extract(raw, BULLET, 1)
    marker = F.when(ordered != "", ordered).otherwise(bullet)
    text = stripped(F.substring(raw, F.length(marker) + 1, F.length(raw)))
    return F.when(text != "", F.struct(text.alias("text"), marker.alias("marker"), (ordered != "").alias("enumerated"), F.lit(0).alias("level"), marker_number(marker).alias("value")))


def shown_entry(line: Column) -> Column:
    """struct(text, marker, ordered, value) of a line as the review page shows it: a bracket may stand on either side, and any number in the marker counts."""
    raw = stripped(line)
    numbered, plain = r"(?i)^(\(?(?:\d+|[A-Za-z]|[ivxlcdm]+)[.)])\s+(.+)$", r"^([•\-–*])\s+(.+)$"
    ordered, bullet = F.regexp_extract(raw, numbered, 1), F.regexp_extract(raw, plain, 1)
    text = F.when(ordered != "", stripped(F.regexp_extract(raw, numbered, 2))).when(bullet != "", stripped(F.regexp_extract(raw, plain, 2))).otherwise(raw)
    value = F.nullif(F.regexp_extract(ordered, r"(\d+)", 1), F.lit("")).cast("int")
    return F.when(text != "", F.struct(text.alias("text"), F.when(ordered != "", ordered).otherwise(bullet).alias("marker"), (ordered != "").alias("ordered"), value.alias("value")))


def list_entries(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\r?\n"), list_entry), lambda e: e.isNotNull())


def bare_lines(text: Column) -> Column:
    """The lines of a text without bullets before them, empty ones left out."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: stripped(F.regexp_replace(x, r"^[•\-–]\s*", "")))
    return F.filter(lines, lambda x: x != "")


def single_line(text: Column) -> Column:
    """All lines in one, without their list markers."""
    return F.array_join(F.transform(list_entries(text), lambda e: e["text"]), " ")


def roman_value(token: Column) -> Column:
    """The value of a roman numeral, read from the right; null for other tokens."""
    digits = F.transform(F.split(F.reverse(F.lower(token)), ""), lambda c: F.element_at(F.create_map(*[F.lit(x) for p in ROMAN.items() for x in p]), c))

    def step(state: Column, digit: Column) -> Column:
        signed = F.when(digit < state["most"], -digit).otherwise(digit)
        return F.struct((state["total"] + signed).alias("total"), F.greatest(state["most"], digit).alias("most"))

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))
    value = F.aggregate(F.filter(digits, lambda d: d.isNotNull()), start, step, lambda s: s["total"])
    return F.when(token.rlike(r"^(?i)[ivxlcdm]+$") & (value != 0), value)


def contents_row(line: Column) -> Column:
    """struct(title, page) of a row with dot leaders, with its page first, or with its page last; else null."""
    out = F.lit(None)
    for pattern, title, page in reversed(ROW_SHAPES):
        cleaned = contents_text(F.regexp_extract(line, pattern, title))
        row = F.struct(cleaned.alias("title"), F.regexp_extract(line, pattern, page).alias("page"))
        out = F.when(line.rlike(pattern) & (cleaned != "") & (F.length(cleaned) <= 300), row).otherwise(out)
    return out


def upper_ratio(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / letters).otherwise(0.0)


def words_in(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(squeezed(text), " ")))


def html_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for mark, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def script_json(text: Column) -> Column:
    """JSON that may stand inside a script element."""
    for mark in ("&", "<", ">", " ", " "):
        text = F.replace(text, F.lit(mark), F.lit(f"\\u{ord(mark):04x}"))
    return text


def log_text(text: Column, limit: int = 300) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1f\x7f]+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def citation_type(citation: Column) -> Column:
    return F.when(citation.rlike(r"\bAct\s+(?:19|20)\d{2}\b"), "Legislation").when(citation.rlike(r"\b\S+\s+v\s+\S+"), "CreativeWork").otherwise("text")


def report_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)\breport\s*(?:no\.?\s*)?(\d+)\b", 1), F.lit(""))


def evidence_key(canonical: Column) -> Column:
    """The first sixteen hexadecimal digits of a digest, a key for cached evidence."""
    return F.substring(F.sha2(canonical, 256), 1, 16)


def data_uri(content: Column, mime: str) -> Column:
    return F.coalesce(F.concat(F.lit(f"data:{mime};base64,"), F.base64(content)), F.lit(""))


def callout_kind(title: Column, words: tuple[tuple[str, str], ...] = (("recommendation", "recommendation"), ("question", "question"), ("case study", "case_study"))) -> Column:
    out = F.lit("callout")
    for word, kind in reversed(words):
        out = F.when(F.contains(F.lower(title), F.lit(word)), kind).otherwise(out)
    return out
