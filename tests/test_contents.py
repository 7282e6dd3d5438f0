"""Contents pages by position, chapter pages, and the outline that comes of them."""

from pyspark.sql import functions as F

from pageloom.functions.text import contents_row
from pageloom.operators import contents, contents_rows

LINES = "doc_id long, page int, pos int, text string, l double, t double, r double, b double, size double, prominent boolean, page_width double, page_height double"
BOX = "struct<l:double,t:double,r:double,b:double>"


def lines_of(spark, rows):
    """(doc, page, text, left, top, size, prominent) as lines on pages of 595 x 842; a character is half as wide as it is high."""
    made = [(doc, page, k, text, float(l), float(t), l + len(text) * size / 2, t + float(size), float(size), bold, 595.0, 842.0) for k, (doc, page, text, l, t, size, bold) in enumerate(rows)]
    return spark.createDataFrame(made, LINES)


def entries_of(frame):
    return [(r.title, r.printed, r.level) for r in frame.orderBy("doc_id", "page", "ord").collect()]


def test_rows_with_words_that_look_like_numerals(spark):
    cases = ["civil rights act", "the old mill  mild", "iv Preface", "Preface  xii", "Glossary .... 12", "12 Scope", "Scope  mcmxc", "No page here"]
    got = spark.createDataFrame([(c,) for c in cases], "t string").select(contents_row(F.col("t")).alias("r")).collect()
    assert [tuple(r.r) if r.r else None for r in got] == [None, None, ("Preface", "iv"), ("Preface", "xii"), ("Glossary", "12"), ("Scope", "12"), ("Scope", "mcmxc"), None]


def test_rows_on_one_line_and_wrapped_ones(spark):
    rows = [(1, 2, "Contents", 70, 60, 18, True), (1, 2, "Preface ........ iv", 70, 100, 11, False), (1, 2, "Chapter 1: A title that is so long that", 70, 130, 11, True), (1, 2, "it goes on here ........ 3", 70, 143, 11, False), (1, 2, "Background ........ 5", 90, 170, 11, False), (1, 2, "and what follows", 90, 183, 11, False), (1, 2, "Chapter 2: Reform", 70, 230, 11, True), (1, 2, "page foot 77", 70, 820, 9, False)]
    assert entries_of(contents_rows.page_entries(lines_of(spark, rows))) == [("Preface", "iv", 1), ("Chapter 1: A title that is so long that it goes on here", "3", 1), ("Background and what follows", "5", 2), ("Chapter 2: Reform", None, 1)]


def test_pages_that_stand_apart_from_titles(spark):
    after = [("Introduction", 1), ("The law as it is", 4), ("Options for reform", 9)]
    rows = [(1, 1, "Contents", 70, 60, 18, True)] + [x for k, (title, page) in enumerate(after) for x in ((1, 1, title, 70, 100 + 30 * k, 11, False), (1, 1, str(page), 500, 100 + 30 * k, 11, False))]
    before = [x for k, (title, page) in enumerate(after) for x in ((2, 1, str(page), 60, 100 + 30 * k, 11, False), (2, 1, title, 120, 101 + 30 * k, 11, False))]
    two_columns = [x for k in range(3) for c in (0, 1) for x in ((3, 1, f"Topic {'ab'[c]}{k} of law", 60 + 270 * c, 100 + 30 * k, 10, False), (3, 1, str(10 * c + k + 1), 250 + 270 * c, 100 + 30 * k, 10, False))]
    got = contents_rows.page_entries(lines_of(spark, rows + before + two_columns))
    assert entries_of(got.where("doc_id < 3")) == 2 * [(title, str(page), 2) for title, page in after]
    assert entries_of(got.where("doc_id = 3")) == [(f"Topic {'ab'[c]}{k} of law", str(10 * c + k + 1), 2) for c in (0, 1) for k in range(3)]


def chapter_fixture(spark):
    body = lambda page: (1, page, "Plain text of the body goes here.", 70, 400, 10, False)
    rows = [body(4), (1, 5, "Chapter 1", 70, 100, 16, True), (1, 5, "The first topic", 70, 130, 24, True), (1, 5, "and its parts", 70, 160, 24, True), (1, 5, "Contents", 70, 300, 12, True), (1, 5, "6  Background", 70, 340, 11, False), (1, 5, "8  New matters", 70, 360, 11, False)]
    rows += [body(6), (1, 9, "2. The second topic", 70, 90, 22, True), (1, 9, "10  Early law", 70, 300, 11, True), (1, 9, "12  Late law", 70, 320, 11, True), (1, 14, "Options for all of us", 70, 90, 20, True), (1, 20, "Chapter 4: Added later", 70, 120, 18, True), body(21)]
    entries = [(1, 0, "Preface", 1, "iii", 3), (1, 1, "Chapter 1: The first topic and its parts", 1, "1", 5), (1, 2, "Background", 3, "2", 6), (1, 3, "2. The second topic", 2, "5", 10), (1, 4, "Recommendations", 1, "8", 12), (1, 5, "Chapter 3: Options for all of us", 1, "10", 14), (1, 6, "Index", 1, "30", 30)]
    return lines_of(spark, rows), spark.createDataFrame(entries, "doc_id long, sequence long, title string, level int, printed string, target long")


def test_chapter_pages_and_their_outline(spark):
    lines, entries = chapter_fixture(spark)
    chapters = contents.chapter_pages(lines, entries)
    found = [(r.number, r.page, r.title) for r in chapters.orderBy("number").collect()]
    assert found == [(1, 5, "Chapter 1: The first topic and its parts"), (2, 9, "Chapter 2: The second topic"), (3, 14, "Chapter 3: Options for all of us"), (4, 20, "Chapter 4: Added later")]
    local = contents.local_entries(contents_rows.page_entries(lines), lines, chapters)
    assert [(r.number, r.title) for r in local.orderBy("number", "place").collect()] == [(1, "Background"), (1, "New matters"), (2, "Early law"), (2, "Late law")]
    outline = contents.with_chapters(entries, chapters)
    rows = [(r.title, r.level, r.target) for r in outline.orderBy("sequence").collect()]
    assert rows == [("Preface", 1, 3), ("Chapter 1: The first topic and its parts", 1, 5), ("Background", 3, 6), ("2. The second topic", 1, 9), ("Recommendations", 2, 12), ("Chapter 3: Options for all of us", 1, 14), ("Chapter 4: Added later", 1, 20), ("Index", 1, 30)]
    whole = contents.with_local_entries(outline, chapters, local)
    titles = [(r.sequence, r.title, r.level) for r in whole.orderBy("sequence").collect()]
    assert titles[:4] == [(0, "Preface", 1), (1, "Chapter 1: The first topic and its parts", 1), (2, "Background", 2), (3, "New matters", 2)] and [t[1] for t in titles[4:8]] == ["2. The second topic", "Recommendations", "Early law", "Late law"]


def test_candidate_pages(spark):
    lines, entries = chapter_fixture(spark)
    got = {r.page for r in contents.candidate_pages(lines, entries).collect()}
    assert {4, 5, 6, 9, 14} <= got and 20 not in got  # numbers 1 to 3 are complete, so that there is no full scan
    assert 20 in {r.page for r in contents.candidate_pages(lines, entries.where("sequence <> 3")).collect()}


def test_bookmarks(spark):
    entries = spark.createDataFrame([(1, 0, "Introduction", 12, 3), (1, 1, "1. The law today", None, 3), (1, 2, "Something else", None, 3)], "doc_id long, sequence long, title string, expected int, contents_end int")
    marks = spark.createDataFrame([(1, "Introduction", 2), (1, "Introduction", 11), (1, "Introduction", 40), (1, "The law today", 20), (1, "Late", -1)], "doc_id long, title string, page int")
    assert [(r.sequence, r.target) for r in contents.bookmark_targets(entries, marks).orderBy("sequence").collect()] == [(0, 11), (1, 20)]


def test_items_of_the_contents(spark):
    items = spark.createDataFrame([(1, 2, "a", "text", "CONTENTS", None), (1, 2, "b", "document_index", "x", None), (1, 2, "c", "text", "inside", (10.0, 10.0, 50.0, 20.0)), (1, 2, "d", "text", "outside", (10.0, 400.0, 50.0, 420.0)), (1, 2, "e", "text", "The law today", None), (1, 2, "f", "text", "Other words", None), (1, 3, "g", "text", "Contents", None)], f"doc_id long, page int, ref string, label string, text string, box {BOX}")
    pages = spark.createDataFrame([(1, 2)], "doc_id long, page int")
    regions = spark.createDataFrame([(1, 2, (0.0, 0.0, 60.0, 60.0))], f"doc_id long, page int, box {BOX}")
    entries = spark.createDataFrame([(1, "1. The law today")], "doc_id long, title string")
    assert sorted(r.ref for r in contents.contents_items(items, pages, regions, entries).collect()) == ["a", "b", "c", "e"]


def test_outline_in_blocks(spark):
    blocks = spark.createDataFrame(
        [(1, 0, "b0", 2, 50.0, "text", "Before", 0.9), (1, 1, "b1", 3, 40.0, "section_header_3", "Chapter 1: Law", 0.8), (1, 2, "b2", 3, 90.0, "list", "", 0.7), (1, 3, "b3", 3, 200.0, "text", "Contents", 0.9), (1, 4, "b4", 3, 800.0, "footer", "3", 0.9), (1, 5, "b5", 3, 210.0, "list", "x", 0.9), (1, 6, "b6", 4, 30.0, "section_header_2", "Early law", 0.6), (1, 7, "b7", 4, 60.0, "list", "kept", 0.6)],
        "doc_id long, ord long, block_id string, page int, top double, label string, text string, confidence double",
    )
    entries = spark.createDataFrame([(1, 0, "Chapter 1: Law", 1, 3, None, "b1"), (1, 1, "Early law", 2, 4, 30.0, None), (1, 2, "Late law", 2, 4, None, None)], "doc_id long, sequence long, title string, level int, target int, target_top double, block_id string")
    panel = spark.createDataFrame([(1, "b2", ["Early law", "Late law", "other"]), (1, "b7", ["Early law", "Late law"])], "doc_id long, block_id string, lines array<string>")
    got = [(r.ord, r.block_id, r.label, r.confidence) for r in contents.applied_outline(blocks, entries, panel).orderBy("ord").collect()]
    assert got == [(0, "b0", "text", 0.9), (1, "b1", "section_header_1", 0.8), (2, "b4", "footer", 0.9), (3, "#/toc-outline/2", "section_header_2", 1.0), (4, "#/toc-outline/1", "section_header_2", 1.0), (5, "b7", "list", 0.6)]


def test_local_lines(spark):
    row = spark.createDataFrame([([], "• One \n\n- Two ..", [["• Three"]]), ([], "• One \n\n- Two ..", None), (["* a"], "b", None)], "e array<string>, t string, c array<array<string>>")
    assert [r[0] for r in row.select(contents.local_lines(F.col("e"), F.col("t"), F.col("c"))).collect()] == [["Three"], ["One", "Two"], ["a"]]


def test_heading_styles(spark):
    items = spark.createDataFrame([(1, 1, "i", (0.0, 0.0, 100.0, 20.0)), (1, 1, "j", (0.0, 50.0, 100.0, 70.0))], f"doc_id long, page int, ref string, box {BOX}")
    spans = spark.createDataFrame([(1, 1, (0.0, 0.0, 40.0, 20.0), 14.2, "Serif", 0), (1, 1, (40.0, 0.0, 90.0, 20.0), 14.2, "Serif-Bold", 0), (1, 1, (0.0, 18.0, 100.0, 40.0), 30.0, "Big", 16)], f"doc_id long, page int, box {BOX}, size double, font string, flags int")
    assert [tuple(r) for r in contents.heading_styles(items, spans).collect()] == [(1, "i", 14.0, "Serif-Bold", 0)]


def test_pages_and_titles_pair_by_cost():
    line = lambda kind, title, left, top, printed=None, starts=False, ends=False: contents_rows.Line(kind, title, printed, starts, ends, False, left, top, left + 5 * len(title), top + 10)
    found = lambda *lines: [(x[0], x[1]) for x in contents_rows.entries_of(list(lines), 595.0)]
    numbers = [line("page", str(k), 500, 100 + 30 * k) for k in range(3)]
    # the title at the number's height wins over a nearer one that is lower
    assert found(*numbers, line("text", "Right", 430, 100), line("text", "Lower but nearer to the page number", 300, 103)) == [("Right", "0")]
    # a line between two rows goes with the nearer one, and with the upper one if both are as near
    upper, lower = line("row", "Upper", 70, 100, "1"), line("row", "Lower", 70, 126, "2")
    assert found(upper, line("text", "near", 70, 111), lower) == [("Upper near", "1"), ("Lower", "2")]
    assert found(upper, line("text", "even", 70, 113), line("row", "Lower", 70, 126, "2")) == [("Upper even", "1"), ("Lower", "2")]
    # text with a number of its own goes to the row below, wherever it is nearer
    assert found(upper, line("text", "2. Own", 70, 112, starts=True), line("row", "Lower", 70, 125, "2")) == [("Upper", "1"), ("2. Own Lower", "2")]
    # four lines above at most, and none across a gap or far aside
    tall = [line("text", f"w{k}", 70, 100 + 12 * k) for k in range(5)]
    assert found(*tall, line("row", "End", 70, 160, "9"))[-1] == ("w1 w2 w3 w4 End", "9")
    assert found(line("text", "aside", 140, 100), line("row", "End", 70, 112, "9")) == [("End", "9")]
    # an open line below which text goes on, and one that a row takes
    assert found(line("open", "Chapter 1: A", 70, 100), line("text", "long one", 70, 113), line("row", "Topic", 90, 140, "3")) == [("Chapter 1: A long one", None), ("Topic", "3")]
    assert found(line("open", "Chapter 1: A", 70, 100), line("row", "long one", 70, 112, "3")) == [("Chapter 1: A long one", "3")]


OUTLINE = "doc_id long, sequence long, title string, level int, printed string, target long"


def test_chapters_are_laid_over_the_outline_in_turn(spark):
    entries = [(1, 0, "Preface", 1, None, 1), (1, 1, "Water rights and the law", 2, None, 10), (1, 2, "Index", 1, None, 40), (2, 0, "Other", 1, None, 5), (3, 0, "3. Land", 2, None, 30)]
    # the second chapter is like what the first has put in, which is a candidate by now; the last one names its row by number alone
    chapters = [(1, 1, 20, "Chapter 1: A wholly new topic"), (1, 2, 21, "Chapter 2: A wholly new topic"), (1, 3, 12, "Chapter 3: Water rights and the laws"), (3, 3, 29, "Chapter 3: Sea and sky")]
    got = contents.with_chapters(spark.createDataFrame(entries, OUTLINE), spark.createDataFrame(chapters, "doc_id long, number int, page int, title string"))
    rows = [(r.doc_id, r.sequence, r.title, r.level, r.target) for r in got.orderBy("doc_id", "sequence").collect()]
    assert rows == [(1, 0, "Preface", 1, 1), (1, 1, "Water rights and the law", 1, 12), (1, 2, "Chapter 1: A wholly new topic", 1, 21), (1, 3, "Index", 1, 40), (2, 0, "Other", 1, 5), (3, 0, "3. Land", 1, 29)]
    # against each chapter on its own: nothing put in is a candidate, and rows stay where they were
    assert contents.with_chapters(spark.createDataFrame(entries, OUTLINE), spark.createDataFrame([], "doc_id long, number int, page int, title string")).count() == 5


def test_folds_against_plain_steps(spark):
    import random

    from pageloom.operators.sequential import similarity

    r = random.Random(2)
    words = "law of water land sea air rights duty courts juries".split()
    title = lambda: " ".join(r.choice(words) for _ in range(r.randint(2, 4)))
    for _ in range(60):
        entries = [(1, False, k, 0, {title()}, None, r.choice((1, 2, 3)), r.choice((None, 3 * k, 3 * k + 1))) for k in range(r.randint(0, 7))]
        chapters = sorted([(1, True, r.randint(1, 20), n, {title()}, n, 1, None) for n in range(1, r.randint(2, 6))], key=lambda c: c[2:4])
        outline = [[k, e[4], e[5], e[6], e[7]] for k, e in enumerate(entries)]
        for c in chapters:
            page = c[2]
            ranked = []
            for row in outline:
                away = abs(row[4] - page) if row[4] is not None else 999
                if away <= 2 or row[2] == c[5]:
                    ranked.append(similarity(c[4], row[1]) + (0.35 if row[2] == c[5] else 0) - 0.04 * away)
                else:
                    ranked.append(-9)
            if ranked and max(ranked) >= 0.55:
                outline[ranked.index(max(ranked))][3:] = [1, page]
            else:
                at = [k for k, row in enumerate(outline) if row[4] is not None and row[4] > page]
                outline.insert(at[0] if at else len(outline), [("new", c[3]), c[4], c[5], 1, page])
        got = contents.lifts(entries + [(*c[:7], c[2]) for c in chapters])
        assert [(x[4], x[5], x[3]) for x in got] == [(row[3], row[4], isinstance(row[0], tuple)) for row in outline]


def test_local_headings_once(spark):
    entries = [(1, 0, "Chapter 1: Law", 1, None, 5), (1, 1, "Early law", 3, None, 6), (1, 2, "Chapter 2: Sea", 1, None, 9)]
    chapters = [(1, 1, 5), (1, 2, 9)]
    local = [(1, 1, 0, "Same heading", "6"), (1, 1, 1, "Same heading", "7"), (1, 1, 2, "Early law", "6"), (1, 1, 3, "The same heading", "8"), (1, 2, 0, "Same heading", "9")]
    got = contents.with_local_entries(spark.createDataFrame(entries, OUTLINE), spark.createDataFrame(chapters, "doc_id long, number int, page int"), spark.createDataFrame(local, "doc_id long, number int, place int, title string, printed string"))
    assert [(r.title, r.level, r.printed) for r in got.orderBy("sequence").collect()] == [("Chapter 1: Law", 1, None), ("Early law", 2, None), ("Same heading", 2, "6"), ("The same heading", 2, "8"), ("Chapter 2: Sea", 1, None), ("Same heading", 2, "9")]


def test_warnings_of_outlines(spark):
    docs = spark.createDataFrame([(1, 10), (2, 10), (3, 0), (4, None), (5, 3)], "doc_id long, pages int")
    pages = spark.createDataFrame([(1, 2), (1, 3)], "doc_id long, page int")
    entries = spark.createDataFrame([(1, 1), (5, 2)], "doc_id long, level int")
    chapters = spark.createDataFrame([(2, 1)], "doc_id long, number int")
    got = {r.doc_id: r.warnings for r in contents.outline_warnings(docs, pages, entries, chapters).collect()}
    assert got == {1: [], 2: [contents.NO_CONTENTS], 3: [contents.NO_PAGES], 4: [contents.NO_PAGES], 5: [contents.NO_CONTENTS, contents.NO_CHAPTERS]}
