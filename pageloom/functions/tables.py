"""Tables in text: parsing rows, and turning tables into text, lists, forms and footnotes.

A table is struct<headers: array<string>, rows: array<array<string>>>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import list_entry, squeezed

DASH = " — "


def cells_of(line: Column, tabs: bool = True) -> Column:
    """The cells of a line: at pipes, else at tabs (if they count), else the line."""
    parts = F.when(F.contains(line, F.lit("|")), F.split(line, r"\|")).otherwise(F.split(line, "\t") if tabs else F.array(line))
    return F.transform(parts, lambda c: F.trim(c))


def table_of(text: Column, tabs: bool = True) -> Column:
    """The table that the lines of a text make; rows are padded, and two or more lines begin with the headers."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = F.transform(lines, lambda x: cells_of(x, tabs))
    width = F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(1)))
    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    named = F.transform(F.sequence(F.lit(1), width), lambda k: F.concat(F.lit("Column "), k.cast("string")))
    with_head = F.struct(F.get(padded, F.lit(0)).alias("headers"), F.slice(padded, 2, F.greatest(F.size(padded), F.lit(1))).alias("rows"))
    body = F.when(F.size(padded) == 0, F.array(F.array(F.lit("")))).otherwise(padded)
    return F.when(F.size(padded) >= 2, with_head).otherwise(F.struct(named.alias("headers"), body.alias("rows")))


def generic_header(header: Column) -> Column:
    return F.coalesce(header == "", F.lit(True)) | header.rlike(r"(?i)^column\s+\d+$")


def _plain(cell: Column) -> Column:
    return squeezed(F.replace(F.coalesce(cell, F.lit("")), F.lit("|"), F.lit(" ")))


def plain_rows(table: Column) -> Column:
    """Rows of clean cells, without empty rows; the telling headers, one a row, if there is none."""
    rows = F.filter(F.transform(table["rows"], lambda r: F.transform(r, _plain)), lambda r: F.exists(r, lambda c: c != ""))
    heads = F.transform(F.filter(F.transform(table["headers"], _plain), lambda h: ~generic_header(h)), lambda h: F.array(h))
    return F.when(F.size(rows) > 0, rows).otherwise(heads)


def _filled(row: Column) -> Column:
    return F.filter(row, lambda c: c != "")


def _facts(table: Column, row: Column) -> Column:
    headers = F.transform(table["headers"], _plain)
    named = F.transform(row, lambda c, k: F.when(c == "", F.lit("")).when(generic_header(F.get(headers, k)), c).otherwise(F.concat(F.get(headers, k), F.lit(": "), c)))
    return _filled(named)


def to_text(table: Column) -> Column:
    """A line a row, cells joined by dashes."""
    return F.array_join(F.transform(plain_rows(table), lambda r: F.array_join(_filled(r), DASH)), "\n")


def to_form(table: Column) -> Column:
    """A line `header: value` a cell, a blank line between rows."""
    return F.array_join(F.transform(plain_rows(table), lambda r: F.array_join(_facts(table, r), "\n")), "\n\n")


def to_footnote(table: Column) -> Column:
    """A sentence `header: value; header: value.` a row."""
    return F.array_join(F.transform(plain_rows(table), lambda r: F.concat(F.rtrim(F.array_join(_facts(table, r), "; "), F.lit(".")), F.lit("."))), " ")


def to_pipes(table: Column) -> Column:
    rows = F.transform(table["rows"], lambda r: F.array_join(r, " | "))
    return F.array_join(F.filter(rows, lambda x: F.regexp_replace(x, r"[|\s]", "") != ""), "\n")


def plain_text(table: Column) -> Column:
    """Headers and rows, cells at pipes; lines without any text are left out."""
    lines = F.transform(F.concat(F.array(table["headers"]), table["rows"]), lambda r: F.array_join(F.transform(r, lambda c: F.trim(c)), " | "))
    return F.array_join(F.filter(lines, lambda x: F.btrim(x, F.lit(" |")) != ""), "\n")


def list_marker(cell: Column) -> Column:
    """The cell if it is a list marker, with a dot after a bare number, letter or numeral; else empty."""
    plain = squeezed(cell)
    whole = plain.rlike(r"^(\((?:\d+|[A-Za-z]|[ivxlcdmIVXLCDM]+)\)|(?:\d+|[A-Za-z]|[ivxlcdmIVXLCDM]+)[.)])$")
    bare = plain.rlike(r"^(?:\d+|[A-Za-z]|[ivxlcdmIVXLCDM]+)$")
    return F.when(whole, plain).when(bare, F.concat(plain, F.lit("."))).otherwise("")


def to_list(table: Column) -> Column:
    """List entries of the rows: a first cell that is a marker becomes the marker, other cells are joined by dashes."""
    heads = F.transform(F.filter(table["headers"], lambda h: F.trim(h) != ""), lambda h: F.array(h))
    rows = F.when(F.size(table["rows"]) > 0, table["rows"]).otherwise(heads)

    def entry(row: Column) -> Column:
        cells = _filled(F.transform(row, _plain))
        marker = F.when(F.size(cells) > 1, list_marker(F.get(cells, F.lit(0)))).otherwise("")
        text = F.array_join(F.when(marker != "", F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1)))).otherwise(cells), DASH)
        parsed = list_entry(text)
        marked = F.struct(parsed["text"].alias("text"), marker.alias("marker"), F.lit(True).alias("enumerated"), parsed["level"].alias("level"))
        return F.when(parsed.isNotNull() & (marker != ""), marked).otherwise(parsed)

    return F.filter(F.transform(rows, entry), lambda e: e.isNotNull())


def piped_lines(table: Column) -> Column:
    """Headers and rows as they are, a line each, cells at pipes; lines of blanks and pipes are left out."""
    lines = F.transform(F.concat(F.array(table["headers"]), table["rows"]), lambda r: F.array_join(r, " | "))
    return F.array_join(F.filter(lines, lambda x: F.regexp_replace(x, r"(?U)[|\s]", "") != ""), "\n")


def marked_lines(table: Column) -> Column:
    """A line a row with cells joined by dashes, a first cell that is a marker put before them; without rows, the telling headers in one line."""
    rows = F.filter(F.transform(table["rows"], lambda r: _filled(F.transform(r, lambda c: F.trim(c)))), lambda r: F.size(r) > 0)
    heads = F.filter(F.transform(table["headers"], lambda h: F.trim(h)), lambda h: (h != "") & ~h.rlike(r"(?i)^column \d+$"))
    used = F.when(F.size(rows) > 0, rows).otherwise(F.array(heads))

    def line(row: Column) -> Column:
        first = F.get(row, F.lit(0))
        marked = first.rlike(r"(?i)^\(?([0-9]+|[A-Za-z]|[ivxlcdm]+)[.)]?$") & (F.size(row) > 1)
        marker = F.when(F.contains(first, F.lit("(")) | first.rlike(r"[.)]$"), first).otherwise(F.concat(first, F.lit(".")))
        return F.when(marked, F.concat(marker, F.lit(" "), F.array_join(F.slice(row, 2, F.greatest(F.lit(1), F.size(row))), DASH))).otherwise(F.array_join(row, DASH))

    return F.array_join(F.transform(F.filter(used, lambda r: F.size(r) > 0), line), "\n")


def bare_line(text: Column) -> Column:
    """The lines of a text in one, without bullets and numbers before them; letters and numerals stay."""
    lines = F.transform(F.split(text, "\r?\n"), lambda x: squeezed(F.regexp_replace(x, r"^\s*(?:[•\-–*]|\d+[.)])\s*", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")
