"""Fixed cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from pageloom.functions import dates, geometry, tables, text
from pageloom.operators import telemetry


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def values(spark, function, inputs):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], "k int, v string")
    return [r[0] for r in rows.orderBy("k").select(function(F.col("v")).alias("x")).collect()]


def test_dates(spark):
    given = ["2020-06-18", "2020-06-18T00:00:00.000Z", "18 June 2020", "18/06/2020", "Published on June 18th, 2020."]
    assert values(spark, dates.display, given) == ["June 18, 2020"] * 5
    assert values(spark, dates.display, ["Spring 2026.", "", None]) == ["Spring 2026", "date not specified", "date not specified"]
    assert values(spark, dates.iso, ["18 Jun 2020", "June 2020", "2020", "2020-06", "31/02/2020", "soon", None]) == ["2020-06-18", "2020-06", "2020", "2020-06", None, None, None]
    assert values(spark, dates.month_year, ["May 2011", "3 June 2012", "2013"]) == ["2011-05", "2012-06-03", "2013"]


def test_lines_and_keys(spark):
    assert values(spark, text.clean_line, ["  ## A  <!-- x -->b |", None]) == ["A b", ""]
    assert values(spark, text.slug, ["A b!C", "!!"]) == ["a-b-c", "section"]
    assert values(spark, text.project_slug, ["The Law: Final Report", "The Law – Consultation Paper"]) == ["the-law", "the-law"]
    assert values(spark, text.section_key, ["Chapter 3. Scope ", "3. Scope", "Scope"]) == ["scope"] * 3
    assert values(spark, text.match_key, ["Law & Order — Chapter 4", "‘It’s’"]) == ["law and order", "it s"]
    assert values(spark, text.is_chapter, ["Chapter iv", "2) x", "Preface", "Chapters"]) == [True, True, False, False]
    assert values(spark, text.roman_value, ["xliv", "MCMXC", "abc", ""]) == [44, 1990, None, None]


def test_list_entries(spark):
    got = values(spark, text.list_entry, ["  (a) first", "1. one", "- x", "\ta | b", "   ", "iv) four", "1.2 x"])
    assert [tuple(g) if g else None for g in got] == [("first", "(a)", True, 1), ("one", "1.", True, 0), ("x", "-", False, 0), ("a b", "", False, 1), None, ("four", "iv)", True, 0), ("1.2 x", "", False, 0)]
    assert values(spark, text.marker_number, ["4.", "(6)", "a."]) == [4, 6, None]


def test_contents_rows(spark):
    got = values(spark, text.contents_row, ["Scope ..... 12", "xii Preface", "Terms   4", "Plain words"])
    assert [tuple(g) if g else None for g in got] == [("Scope", "12"), ("Preface", "xii"), ("Terms", "4"), None]


@pytest.mark.parametrize(
    ("shape", "expected"),
    [(tables.to_text, "Structure — Review"), (tables.to_footnote, "Item: Structure; Status: Review."), (tables.to_form, "Item: Structure\nStatus: Review"), (tables.to_pipes, "Structure | Review")],
)
def test_tables(spark, shape, expected):
    assert values(spark, lambda c: shape(tables.table_of(c)), ["Item | Status\nStructure | Review"]) == [expected]


def test_odd_tables(spark):
    got = values(spark, tables.table_of, ["a\tb", "", None, "a|b|c\nd"])
    assert [(g.headers, g.rows) for g in got] == [(["Column 1", "Column 2"], [["a", "b"]]), (["Column 1"], [[""]]), (["Column 1"], [[""]]), (["a", "b", "c"], [["d", "", ""]])]
    entries = values(spark, lambda c: tables.to_list(tables.table_of(c)), ["x|y\n1|one|more\n(b)|two"])[0]
    assert [(e.marker, e.text, e.enumerated) for e in entries] == [("1.", "one — more", True), ("(b)", "two", True)]


def test_escaping(spark):
    assert values(spark, text.html_escape, ["<a href=\"x\">&'"]) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"]
    assert "<" not in values(spark, text.script_json, ["</script> "])[0]
    assert values(spark, text.log_text, ["a\nb", "x" * 301]) == ["a b", "x" * 300 + "…"]


def test_geometry(spark):
    lit = lambda *v: geometry.box(*[F.lit(float(x)) for x in v])
    assert one(spark, geometry.iou(lit(0, 0, 2, 2), lit(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert one(spark, geometry.iou(lit(0, 0, 0, 0), lit(0, 0, 0, 0))) == 0
    assert tuple(one(spark, geometry.top_left(lit(1, 90, 5, 80), F.lit("BOTTOMLEFT"), F.lit(100.0)))) == (1, 10, 5, 20)
    cut = one(spark, geometry.crop(lit(100, 100, 200, 120), F.lit(600.0), F.lit(800.0), F.lit(600), F.lit(800)))
    assert (cut.right - cut.left, cut.bottom - cut.top) == (140, 60)
    grey = geometry.rgb(F.lit(0xE6E6E6))
    span = lambda words, size, alpha: geometry.is_artifact(F.lit(words), F.lit(size), grey, F.lit(alpha), F.lit(0.0), lit(50, 50, 90, 70), F.lit(500000.0))
    assert one(spark, span(3, 40.0, 1.0)) and one(spark, span(3, 10.0, 0.2)) and not one(spark, span(30, 11.0, 1.0))
    assert tuple(one(spark, geometry.rgb(F.lit(0x010203)))) == (1, 2, 3)


def test_telemetry(spark):
    assert one(spark, telemetry.estimate_seconds(F.lit(100), F.lit(2.8), F.lit(30.0), F.lit(False))) == 310
    assert one(spark, telemetry.estimate_seconds(F.lit(100), F.lit(2.8), F.lit(30.0), F.lit(True))) == 548
    assert [one(spark, telemetry.remaining_text(F.lit(s))) for s in (5, 65, 3725)] == ["5 sec", "1 min 5 sec", "1 hr 2 min 5 sec"]
