"""Dates of publications: to ISO with their precision, and for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats of whole dates, in the order in which they are tried (fixed values).
WHOLE = ("yyyy-M-d", "yyyy/M/d", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy")
MONTHS = ("MMMM yyyy", "MMM yyyy")


def bare(value: Column) -> Column:
    """The date without `published on`, ordinal endings and the last dot."""
    out = F.rtrim(F.trim(F.coalesce(value, F.lit(""))), F.lit("."))
    out = F.regexp_replace(out, r"(?i)^published\s+(?:on\s+)?", "")
    return F.trim(F.regexp_replace(out, r"(?i)(\d)(?:st|nd|rd|th)\b", "$1"))


def _first(text: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def iso(value: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD, as precise as the date is; null for what is none."""
    text = bare(value)
    partial = text.rlike(r"^(?:19|20)\d{2}(?:-(?:0[1-9]|1[0-2])(?:-(?:0[1-9]|[12]\d|3[01]))?)?$")
    whole, month = _first(text, WHOLE), _first(text, MONTHS)
    return F.when(text == "", F.lit(None)).when(partial, text).otherwise(F.coalesce(F.date_format(whole, "yyyy-MM-dd"), F.date_format(month, "yyyy-MM")))


def display(value: Column) -> Column:
    """`June 18, 2020`; what is no whole date stays as it is, and blank dates are said to be missing."""
    raw = F.rtrim(F.trim(F.coalesce(value, F.lit(""))), F.lit("."))
    text = bare(value)
    found = F.coalesce(F.try_to_date(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(?:T[0-9:.]+(?:Z|[+-]\d{2}:\d{2})?)?$", 1), "yyyy-MM-dd"), _first(text, WHOLE))
    return F.when(raw == "", "date not specified").otherwise(F.coalesce(F.date_format(found, "MMMM d, yyyy"), raw))


def month_year(value: Column) -> Column:
    """`Month YYYY` and `D Month YYYY` to ISO; other texts unchanged."""
    text = F.trim(value)
    return F.coalesce(F.date_format(F.try_to_date(text, "d MMMM yyyy"), "yyyy-MM-dd"), F.date_format(F.try_to_date(text, "MMMM yyyy"), "yyyy-MM"), text)


def epoch_to_iso(seconds: Column) -> Column:
    """Epoch seconds as an ISO instant of UTC, whatever the session's zone."""
    at = F.timestamp_seconds(seconds)
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
