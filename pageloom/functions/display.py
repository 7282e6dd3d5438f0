"""What people see of documents, review items and audit entries: labels, messages, previews, dates, and edits of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.dates import bare

#: Month names that dates are shown with (fixed values).
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: Fields of a review change that are too large for the audit log.
LARGE = ("corrected_text", "corrected_table")
#: Messages by status of a failed request (fixed texts); 0 stands for no answer at all.
MESSAGES = {
    0: "The connection was interrupted. Please check your connection and try again.",
    401: "Your session has expired. Please sign in again.",
    408: "The request took too long. Large documents can take longer; please try again.",
    413: "This file is too large to upload. Choose a PDF under the upload limit.",
    415: "This file type is not supported. Please upload a PDF document.",
    422: "The PDF could not be read. Please check the file and upload it again.",
}
SERVER_MESSAGE = "The document could not be processed right now. Please try again."
OTHER_MESSAGE = "The request could not be completed. Please try again."
#: What the answer's own explanation doesn't replace.
ALWAYS = (0, 401, 408)


def file_title(name: Column, drop: tuple[str, ...] = ("forweb", "web", "fnl", "parl")) -> Column:
    """The words of a file's name without its ending, folders and words of the trade; letter case is left to the title rules."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")
    words = F.translate(stem, "_-", "  ")
    return F.trim(F.regexp_replace(F.regexp_replace(words, rf"(?i)\b(?:{'|'.join(drop)})\b", ""), r"(?U)\s+", " "))


def joined_values(values: Column) -> Column:
    """The values of a list that aren't blank, joined by semicolons."""
    return F.array_join(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""), "; ")


def redacted(changes: Column, large: tuple[str, ...] = LARGE) -> Column:
    """A map of changes with large fields replaced by the word `updated`."""
    return F.transform_values(changes, lambda k, v: F.when(k.isin(*large), F.lit("updated")).otherwise(v))


def item_label(title: Column, page: Column) -> Column:
    return F.when(page.isNull(), title).otherwise(F.concat(title, F.lit(" (p."), page.cast("string"), F.lit(")")))


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w.capitalize() for w in rest)


def with_camel_names(df: DataFrame) -> DataFrame:
    """df with its column names in the form of interchange: published_date becomes publishedDate."""
    return df.toDF(*[camel(c) for c in df.columns])


def failure_message(status: Column, detail: Column) -> Column:
    """What a user is told of a failed request: the answer's own explanation, if there is one and the status allows, else a fixed text."""
    out = F.when(status >= 500, SERVER_MESSAGE).otherwise(OTHER_MESSAGE)
    for code, text in MESSAGES.items():
        out = F.when(status == code, text).otherwise(out)
    return F.when(detail.isNotNull() & ~status.isin(*ALWAYS), detail).otherwise(out)


def evidence_version(block_id: Column, item_id: Column, page: Column, bounds: Column) -> Column:
    """A key that changes when an item's evidence does; unknown parts are left out."""
    return F.concat_ws(":", F.coalesce(block_id, item_id), page.cast("string"), *[bounds[c].cast("string") for c in ("left", "top", "right", "bottom")])


def array_preview(items: Column, shown: int = 8) -> Column:
    """The first items of a list, and how many more there are."""
    head = F.array_join(F.slice(items, 1, shown), ", ")
    return F.when(F.size(items) > shown, F.concat(head, F.lit(" and "), (F.size(items) - shown).cast("string"), F.lit(" more"))).otherwise(head)


def with_header(headers: Column, at: Column, value: Column) -> Column:
    return F.transform(headers, lambda h, k: F.when(k == at, value).otherwise(h))


def with_cell(headers: Column, rows: Column, row: Column, at: Column, value: Column) -> Column:
    """Rows with one cell set; that row gets as many cells as there are headers."""
    width = F.sequence(F.lit(0), F.size(headers) - 1)
    edited = lambda cells: F.transform(width, lambda c: F.when(c == at, value).otherwise(F.coalesce(F.get(cells, c), F.lit(""))))
    return F.transform(rows, lambda cells, k: F.when(k == row, edited(cells)).otherwise(cells))


def with_column(headers: Column, rows: Column) -> tuple[Column, Column]:
    """Headers and rows with one more column, named by its number."""
    named = F.concat(F.lit("Column "), (F.size(headers) + 1).cast("string"))
    return F.concat(headers, F.array(named)), F.transform(rows, lambda cells: F.concat(cells, F.array(F.lit(""))))


def without_column(headers: Column, rows: Column, at: Column) -> tuple[Column, Column]:
    """Headers and rows without one column; a table keeps its last one."""
    single = F.size(headers) == 1
    less = lambda cells: F.filter(cells, lambda c, k: k != at)
    return F.when(single, headers).otherwise(less(headers)), F.when(single, rows).otherwise(F.transform(rows, less))


def with_row(headers: Column, rows: Column) -> Column:
    return F.concat(rows, F.array(F.transform(headers, lambda h: F.lit(""))))


def without_row(rows: Column, at: Column) -> Column:
    return F.filter(rows, lambda r, k: k != at)


def item_tone(status: Column, band: Column) -> Column:
    """How an item is coloured: settled, urgent, or neither."""
    settled = F.coalesce(status.isin("accepted", "edited", "removed"), F.lit(False))
    return F.when(settled, "ok").when((status == "needs_attention") | (band == "low"), "alert").otherwise("warn")


def confidence_label(band: Column, score: Column) -> Column:
    names = F.when(band == "high", "High").when(band == "med", "Medium").otherwise("Low")
    return F.concat(names, F.lit(" confidence, "), F.floor(score * 100 + 0.5).cast("string"), F.lit("%"))


def _shown(year: Column, month: Column, day: Column) -> Column:
    """`June 18, 2020`, or null where there is no such day."""
    date = F.when(month.between(1, 12), F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd"))
    names = F.array(*[F.lit(m) for m in MONTHS])
    return F.when(date.isNotNull(), F.concat(F.get(names, month - 1), F.lit(" "), day.cast("string"), F.lit(", "), year.cast("string")))


def _month(name: Column) -> Column:
    """The first month whose name begins so, or 0."""
    out = F.lit(0)
    for k, month in reversed(list(enumerate(MONTHS, 1))):
        out = F.when(F.startswith(F.lit(month.lower()), F.lower(name)), k).otherwise(out)
    return out


def short_date(value: Column) -> Column:
    """The date of an exported page: ISO dates in words, all others as they are but for ordinal endings."""
    raw = F.rtrim(F.trim(F.coalesce(value, F.lit(""))), F.lit("."))
    found = F.regexp_extract(bare(value), r"^(\d{4}-\d{2}-\d{2})(?:[T ]\d{2}(?::\d{2}){0,2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)?$", 1)
    date = F.try_to_date(F.nullif(found, F.lit("")), "yyyy-MM-dd")
    return F.when(raw == "", "date not specified").otherwise(F.coalesce(F.date_format(date, "MMMM d, yyyy"), bare(value)))


def long_date(value: Column) -> Column:
    """The date of a page on screen: ISO, day first in figures, and months by name or its beginning; others as they are."""
    raw = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"\.$", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?i)^published\s+(?:on\s+)?", ""), r"(?i)(\d)(?:st|nd|rd|th)\b", "$1"))

    def parts(pattern: str, order: tuple[int, int, int], named: bool = False) -> Column:
        year, month, day = (F.regexp_extract(text, pattern, g) for g in order)
        number = _month(month) if named else month.try_cast("int")
        return F.when(text.rlike(pattern), _shown(year.try_cast("int"), number, day.try_cast("int")))

    found = F.coalesce(
        parts(r"^(\d{4})[-/](\d{2})[-/](\d{2})(?:[T\s].*)?$", (1, 2, 3)),
        parts(r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?:[T\s].*)?$", (3, 2, 1)),
        parts(r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$", (3, 2, 1), True),
        parts(r"^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})$", (3, 1, 2), True),
        text,
    )
    return F.when(raw == "", "date not specified").otherwise(found)


def audit_time(value: Column, zone: str = "UTC") -> dict[str, Column]:
    """date and time of an instant as the audit pages show them; what is no instant is its own date."""
    at = F.convert_timezone(F.current_timezone(), F.lit(zone), F.try_to_timestamp(value).cast("timestamp_ntz"))
    return {"date": F.coalesce(F.date_format(at, "dd MMM yyyy"), value), "time": F.coalesce(F.lower(F.date_format(at, "hh:mm:ss a")), F.lit(""))}
