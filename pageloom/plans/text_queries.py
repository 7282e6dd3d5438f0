"""Queries over text lines, tables in text, titles and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import dates, tables, text
from pageloom.operators import layout, metadata
from pageloom.plans.inputs import LINES_SQL, table, text_lines

#: List markers that the synthetic queries put before lines; level is two blanks each.
MARKERS = ("1. ", "(a) ", "iv) ", "- ", "* ", "", "B. ", "12) ")
ORDERED_SQL = r"^(\((?:[0-9]+|[A-Za-z]|[ivxlcdmIVXLCDM]+)\)|(?:[0-9]+|[A-Za-z]|[ivxlcdmIVXLCDM]+)[.)])\s+"
BULLET_SQL = r"^([•\-–*·])\s+"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with list markers and indents."""
    k = F.col("p_partkey")
    marker = F.element_at(F.array(*[F.lit(m) for m in MARKERS]), (k % len(MARKERS) + 1).cast("int"))
    line = F.concat(F.repeat(F.lit(" "), (k % 5).cast("int")), marker, F.col("p_name"), F.lit(" "))
    return table(spark, sf_dir, "part").select(k.alias("part"), line.alias("line"))


MARKED_SQL = "SELECT p_partkey AS part, repeat(' ', p_partkey % 5) || " + "CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(MARKERS)) + " END || p_name || ' ' AS line FROM part"


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), text.clean_line(F.col("line")).alias("line"))


def list_line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("part", text.list_entry(F.col("line")).alias("e")).select("part", "e.*")


def single_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of part names of one brand and size as one heading line."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("- "), "p_name", F.lit("\n2) "), "p_brand").alias("t"))
    return parts.select("p_partkey", text.single_line(F.col("t")).alias("heading"))


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table of each part: two headers, the second generic for some, and two rows."""
    second = F.when(F.col("p_partkey") % 3 == 0, "Column 2").otherwise("Size")
    lines = F.concat(F.lit("Item | "), second, F.lit("\n"), "p_name", F.lit(" | "), F.col("p_size").cast("string"), F.lit("\n2. | "), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", tables.table_of(lines).alias("t"))


def _table_query(shape, name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _tables(spark, sf_dir).select("p_partkey", shape(F.col("t")).alias("out"))

    query.__name__ = name
    return query


def table_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with pipes, cell by cell."""
    rows = text_lines(spark, sf_dir).where(F.contains("line", F.lit("|")))
    return rows.select("doc_id", "line_no", F.posexplode(tables.cells_of(F.col("line"))).alias("column", "cell")).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("column").cast("bigint").alias("column"), "cell")


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat("p_name", F.lit(" - Final Report: "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_type")).alias("slug"), text.project_slug(title).alias("project_slug"))


def section_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.element_at(F.array(F.lit("Chapter 3. "), F.lit("4. "), F.lit("Part iv "), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int")), F.initcap("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.section_key(title).alias("key"), text.is_chapter(title).alias("is_chapter"))


def uppercase_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 2 to 16 words that are nearly all capitals."""
    rows = text_lines(spark, sf_dir).where((text.upper_ratio(F.col("line")) >= 0.86) & text.words_in(F.col("line")).between(2, 16))
    return rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


def contents_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    page = F.when(k % 7 == 0, "xiv").otherwise((k % 300).cast("string"))
    line = F.when(k % 3 == 0, F.concat("p_name", F.lit(" ..... "), page)).when(k % 3 == 1, F.concat(page, F.lit(" "), "p_name")).otherwise(F.concat("p_name", F.lit("   "), page))
    return table(spark, sf_dir, "part").select("p_partkey", text.contents_row(line).alias("r")).select("p_partkey", "r.title", "r.page")


def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals made of the digits of part keys."""
    k = F.col("p_partkey")
    digit = lambda n, names: F.element_at(F.array(*[F.lit(x) for x in names]), (n % 10 + 1).cast("int"))
    token = F.concat(digit(F.floor(k / 100), HUNDREDS), digit(F.floor(k / 10), TENS), digit(k, ONES))
    return table(spark, sf_dir, "part").select("p_partkey", F.upper(token).alias("token"), F.coalesce(text.roman_value(F.upper(token)), F.lit(0)).cast("bigint").alias("value"))


ONES = ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")
TENS = ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc")
HUNDREDS = ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm")


def escaped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('<b class="x">'), "p_name", F.lit(" & 'co'</b>"))
    return table(spark, sf_dir, "part").select("p_partkey", text.html_escape(raw).alias("html"), text.script_json(raw).alias("json"), text.evidence_key(raw).alias("key"))


#: Shapes of a date in the synthetic date queries.
SHAPES = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMMM yyyy", "yyyy")
DUCK_SHAPES = ("%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%-d %B %Y", "%-d %b %Y", "%B %-d, %Y", "%B %-d %Y", "%b %-d, %Y", "%B %Y", "%Y")


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.lit(None).cast("string")
    for k, shape in enumerate(SHAPES):
        shown = F.when(F.col("o_orderkey") % len(SHAPES) == k, F.date_format("o_orderdate", shape)).otherwise(shown)
    prefix = F.when(F.col("o_orderkey") % 5 == 0, "Published on ").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(prefix, shown, F.lit(".")).alias("shown"))


def date_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir).select("o_orderkey", dates.iso(F.col("shown")).alias("iso"))


def date_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir).select("o_orderkey", dates.display(F.col("shown")).alias("display"))


def repeated_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines that the documents of a source repeat."""
    sources = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line"))
    return layout.repeated_fragments(sources, ["source"], "line")


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of made-up legal prose: (doc_id, page, pos, line)."""
    k = F.col("l_partkey")
    line = F.element_at(F.array(*[F.lit(x) for x in STATEMENTS]), (k % len(STATEMENTS) + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 4 + 1).cast("int").alias("page"), (F.col("l_linenumber") * 1000000 + k).alias("pos"), line.alias("line"))


STATEMENTS = (
    "See the Evidence Act 2008 (Vic) and Smith v Jones [2010] VSC 12",
    "ISBN 978-0-12345-678-9",
    "Courts of Victoria and of New South Wales",
    "Report of the Example Law Office on Queensland",
    "Published by the Example Law Office. Copyright 2011",
    "The Crimes Act 1958 applies in Tasmania (Tas)",
    "Nothing of note",
)
ORGANISATION = "Example Law Office"


def jurisdiction_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.jurisdictions(_statements(spark, sf_dir))


def publisher_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.publishers(_statements(spark, sf_dir), ORGANISATION)


def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.citations(_statements(spark, sf_dir))


def title_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best title of each web page from its title element, heading and upper-case lines."""
    pages = table(spark, sf_dir, "pages")
    flat = F.regexp_replace(F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1), r"<[^>]*>", "\n")
    lines = pages.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), F.posexplode(F.split(flat, "\n+")).alias("pos", "line"))
    known = pages.select(F.col("page_id").alias("doc_id"), F.regexp_extract("html", r"<title>(.*?)</title>", 1).alias("title"))
    return metadata.titles(lines, known, ORGANISATION)


def page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of each document of statements with cover and copyright dates put in."""
    months = F.element_at(F.array(*[F.lit(m) for m in ("May 2011", "3 June 2012", "2013")]), (F.col("pos") % 3 + 1).cast("int"))
    lines = _statements(spark, sf_dir).withColumn("line", F.when(F.col("pos") % 4 == 0, F.concat(F.lit("Final Report: "), months)).when(F.col("pos") % 4 == 1, F.concat(F.lit("© "), months)).otherwise(F.col("line")))
    return metadata.dates_of(lines)


table_to_text = _table_query(tables.to_text, "table_to_text")
table_to_form = _table_query(tables.to_form, "table_to_form")
table_to_footnote = _table_query(tables.to_footnote, "table_to_footnote")
table_plain_text = _table_query(tables.to_pipes, "table_plain_text")
table_to_list = _table_query(lambda t: F.array_join(F.transform(tables.to_list(t), lambda e: F.concat(e["marker"], F.lit("~"), e["text"])), "\n"), "table_to_list")

QUERIES = {f.__name__: f for f in (clean_lines, list_line_parse, single_line, table_parse, table_to_text, table_to_form, table_to_footnote, table_plain_text, table_to_list, slugs, section_keys, uppercase_candidates, contents_rows, roman_numerals, escaped_titles, date_iso, date_display, repeated_fragments, jurisdiction_vote, publisher_vote, citation_extract, title_candidates, page_dates)}

_HEAD = "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Size: ' END"
_CASES = " ".join(f"WHEN {k} THEN strftime(o_orderdate, '{s}')" for k, s in enumerate(DUCK_SHAPES))
_N = len(SHAPES)
_STATE = "(SELECT l_orderkey AS doc_id, (l_linenumber % 4 + 1)::INT AS page, l_linenumber * 1000000 + l_partkey AS pos, CASE l_partkey % 7 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(STATEMENTS)) + " END AS line FROM lineitem)"
_places = " UNION ALL ".join(f"SELECT {k} AS rule, '{place}' AS place, line LIKE '%{word}%' AS hit, * FROM {_STATE}" for k, (place, word) in enumerate((("Victoria, Australia", "Vic"), ("New South Wales, Australia", "New South Wales"), ("Queensland, Australia", "Queensland"), ("Tasmania, Australia", "Tas"))))
ORACLES = {
    "clean_lines": f"SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(regexp_replace(line, '^\\s{{0,3}}#{{1,6}}\\s*', ''), '<!--.*?-->', '', 'g'), '\\s+', ' ', 'g'), ' |' || chr(9)) AS line FROM ({LINES_SQL})",
    "list_line_parse": f"""
SELECT part, trim(substr(v, length(marker) + 1)) AS text, marker, o <> '' AS enumerated, (indent // 2)::INT AS level
FROM (SELECT part, v, indent, o, CASE WHEN o <> '' THEN o ELSE regexp_extract(v, '{BULLET_SQL}', 1) END AS marker
      FROM (SELECT part, trim(line) AS v, length(rtrim(line)) - length(trim(line)) AS indent, regexp_extract(trim(line), '{ORDERED_SQL}', 1) AS o FROM ({MARKED_SQL})))""",
    "single_line": "SELECT p_partkey, p_name || ' ' || p_brand AS heading FROM part",
    "table_parse": f"SELECT doc_id, line_no, unnest(range(len(c))) AS \"column\", trim(unnest(c)) AS cell FROM (SELECT doc_id, line_no, string_split(line, '|') AS c FROM ({LINES_SQL}) WHERE contains(line, '|'))",
    "table_to_text": "SELECT p_partkey, p_name || ' — ' || p_size || chr(10) || '2. — ' || p_brand AS out FROM part",
    "table_to_form": f"SELECT p_partkey, 'Item: ' || p_name || chr(10) || {_HEAD} || p_size || chr(10) || chr(10) || 'Item: 2.' || chr(10) || {_HEAD} || p_brand AS out FROM part",
    "table_to_footnote": f"SELECT p_partkey, 'Item: ' || p_name || '; ' || {_HEAD} || p_size || '. Item: 2.; ' || {_HEAD} || p_brand || '.' AS out FROM part",
    "table_plain_text": "SELECT p_partkey, p_name || ' | ' || p_size || chr(10) || '2. | ' || p_brand AS out FROM part",
    "table_to_list": "SELECT p_partkey, '~' || p_name || ' — ' || p_size || chr(10) || '2.~' || p_brand AS out FROM part",
    "slugs": "SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS project_slug FROM part",
    "section_keys": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN 'part iv ' ELSE '' END || lower(p_name) AS key, p_partkey % 4 <> 3 AS is_chapter FROM part",
    "uppercase_candidates": f"SELECT doc_id, line_no, line FROM ({LINES_SQL}) WHERE length(regexp_replace(line, '[^\\p{{Lu}}]', '', 'g')) >= 0.86 * length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) AND regexp_matches(line, '\\p{{L}}') AND len(regexp_extract_all(line, '[^ \\t\\n\\x0b\\x0c\\r]+')) BETWEEN 2 AND 16",
    "contents_rows": "SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 7 = 0 THEN 'xiv' ELSE (p_partkey % 300)::VARCHAR END AS page FROM part",
    "roman_numerals": "SELECT p_partkey, upper(CASE p_partkey // 100 % 10 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(HUNDREDS)) + " END || CASE p_partkey // 10 % 10 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TENS)) + " END || CASE p_partkey % 10 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(ONES)) + " END) AS token, p_partkey % 1000 AS value FROM part",
    "escaped_titles": "SELECT p_partkey, '&lt;b class=&quot;x&quot;&gt;' || p_name || ' &amp; &#x27;co&#x27;&lt;/b&gt;' AS html, '\\u003cb class=\"x\"\\u003e' || p_name || ' \\u0026 ''co''\\u003c/b\\u003e' AS json, left(sha256('<b class=\"x\">' || p_name || ' & ''co''</b>'), 16) AS key FROM part",
    "date_iso": f"SELECT o_orderkey, CASE o_orderkey % {_N} WHEN 10 THEN strftime(o_orderdate, '%Y-%m') WHEN 11 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders",
    "date_display": f"SELECT o_orderkey, CASE WHEN o_orderkey % {_N} IN (10, 11) THEN CASE WHEN o_orderkey % 5 = 0 THEN 'Published on ' ELSE '' END || CASE o_orderkey % {_N} {_CASES} END ELSE strftime(o_orderdate, '%B %-d, %Y') END AS display FROM orders",
    "repeated_fragments": "SELECT source, fragment, count(*) AS times FROM (SELECT source, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g'))) AS fragment FROM documents) WHERE fragment <> '' AND length(fragment) <= 60 GROUP BY 1, 2 HAVING count(*) >= 3",
    "jurisdiction_vote": f"""
WITH v AS (SELECT doc_id, place, rule, count(*) AS n, min(pos) AS first_at, min_by(page, pos) AS page FROM ({_places}) WHERE hit GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at, rule) AS k FROM v)
SELECT doc_id, place AS value, page, n AS matches, CASE n WHEN 1 THEN 0.72 WHEN 2 THEN 0.84 ELSE 0.93 END::DOUBLE AS confidence FROM r WHERE k = 1""",
    "publisher_vote": f"""
WITH p AS (SELECT doc_id, min_by(page, pos) AS page FROM {_STATE} WHERE line LIKE 'Published by%' GROUP BY 1),
o AS (SELECT doc_id, count(*) AS n, min_by(page, pos) AS page FROM {_STATE} WHERE line LIKE '%Example Law Office%' GROUP BY 1)
SELECT o.doc_id, 'Example Law Office' AS value, coalesce(p.page, o.page) AS page, CASE WHEN p.doc_id IS NOT NULL THEN 'published_by' ELSE 'organisation_name' END AS method,
       CASE WHEN p.doc_id IS NOT NULL THEN 0.98 WHEN n = 1 THEN 0.78 WHEN n = 2 THEN 0.84 ELSE 0.9 END::DOUBLE AS confidence
FROM o LEFT JOIN p ON p.doc_id = o.doc_id""",
    "citation_extract": f"""
WITH c AS (
  SELECT doc_id, pos, 2 AS kind_no, 'legislation' AS kind, 'Evidence Act 2008 (Vic)' AS value FROM {_STATE} WHERE line LIKE 'See %'
  UNION ALL SELECT doc_id, pos, 3, 'case', 'Smith v Jones [2010] VSC 12' FROM {_STATE} WHERE line LIKE 'See %'
  UNION ALL SELECT doc_id, pos, 0, 'isbn', 'ISBN 978-0-12345-678-9' FROM {_STATE} WHERE line LIKE 'ISBN%'
  UNION ALL SELECT doc_id, pos, 2, 'legislation', 'Crimes Act 1958' FROM {_STATE} WHERE line LIKE 'The Crimes%'),
d AS (SELECT doc_id, value, kind, min(pos) AS first_at, min_by(kind_no, pos) AS kn FROM c GROUP BY 1, 2, 3)
SELECT doc_id, string_agg(value, '; ' ORDER BY first_at, kn) AS citations, count(*) AS found,
       round(least(0.95, 0.55 + 0.06 * least(count(*), 4) + CASE WHEN bool_or(kind = 'isbn') THEN 0.08 ELSE 0 END + 0.04 * (count(DISTINCT kind) - 1)), 2)::DOUBLE AS confidence
FROM d GROUP BY doc_id""",
    "page_dates": f"""
WITH s AS (SELECT doc_id, page, pos, CASE WHEN pos % 4 = 0 AND pos % 3 < 2 THEN 0 WHEN pos % 4 = 1 AND pos % 3 < 2 THEN 2 WHEN pos % 4 = 1 THEN 5 END AS rule, ['2011-05', '2012-06-03', '2013'][pos % 3 + 1] AS value FROM {_STATE}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rule, pos) AS k FROM s WHERE rule IS NOT NULL)
SELECT doc_id, value, page, CASE rule WHEN 0 THEN 'cover_report_date' WHEN 2 THEN 'copyright_date' ELSE 'copyright_year' END AS method, CASE rule WHEN 0 THEN 0.98 WHEN 2 THEN 0.94 ELSE 0.82 END::DOUBLE AS confidence FROM r WHERE k = 1""",
}
