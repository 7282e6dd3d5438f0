"""Whole pages of publications."""

import random
import xml.etree.ElementTree as ElementTree

from pageloom.operators import publication_pages as pages

ITEM, CELL = "struct<text:string,level:int,ordered:boolean,value:int>", "struct<text:string,column_header:boolean,row_header:boolean,row_span:int,col_span:int>"
BLOCKS = f"doc_id long, section_id string, block_id string, parent_id string, ord int, type string, level int, slug string, text string, list_items array<{ITEM}>, style string, start int, cells array<array<{CELL}>>, caption string, title string, variant string"
HEADINGS, SECTIONS, NOTES = "doc_id long, section_id string, ord int, level int, slug string, text string", "doc_id long, section_id string, position int, title string, is_chapter boolean", "doc_id long, section_id string, number int, note_id string, text string"


def test_lists_are_balanced_for_any_levels():
    r = random.Random(3)
    for _ in range(300):
        levels = [r.randint(1, 7) for _ in range(r.randint(1, 12))]
        html = pages.nested_links([(1, "s", k, level, f"h{k}", f"t{k}") for k, level in enumerate(levels)])[0][2]
        root = ElementTree.fromstring(f"<div>{html}</div>")
        assert [a.text for a in root.iter("a")] == [f"t{k}" for k in range(len(levels))]
        depth = {}

        def walk(node, at, depth=depth):
            for child in node:
                if child.tag == "a":
                    depth[child.text] = at
                walk(child, at + (child.tag == "ul"), depth)

        walk(root, 0)
        for k in range(1, len(levels)):  # deeper than the one before it, or beside or above it
            assert (depth[f"t{k}"] > depth[f"t{k - 1}"]) == (levels[k] > levels[k - 1])


def test_blocks_in_boxes_in_boxes():
    rows = [(1, "s", 0, "a", None, "<p>a</p>", ""), (1, "s", 1, "box", None, "<section>", "</section>"), (1, "s", 2, "in", "box", "<p>in</p>", ""), (1, "s", 3, "deep", "box", "<section>", "</section>"), (1, "s", 4, "last", "deep", "<p>last</p>", ""), (1, "s", 5, "lost", "none", "<p>lost</p>", ""), (1, "s", 6, "x", "y", "x", ""), (1, "s", 7, "y", "x", "y", "")]
    assert pages.joined_up(rows) == [(1, "s", "<p>a</p><section><p>in</p><section><p>last</p></section></section><p>lost</p>")]


def test_publication(spark):
    block = lambda k, kind, parent=None, text=None, **more: (1, more.get("section", "s1"), f"b{k}", parent, k, kind, more.get("level"), f"x{k}", text, more.get("items"), more.get("style"), more.get("start"), more.get("cells"), more.get("caption"), more.get("title"), more.get("variant"))
    cells = [[("Head", True, False, 1, 2)], [("side 1", False, True, 2, 1), ("a <b>", False, False, None, None)]]
    blocks = [block(0, "paragraph", text="Law.1 & page 2"), block(1, "box_section", title="Case <1>", variant="Case-Study!"), block(2, "list", "b1", items=[("one 1", 1, True, 3), ("in", 2, False, None)], style="ordered", start=3), block(3, "table", "b1", cells=cells, caption=" Rivers "), block(4, "heading", text="Next", level=2), block(5, "paragraph", text=" "), block(6, "paragraph", text="see 1", section="s2")]
    notes = spark.createDataFrame([(1, "s1", 1, "n1", "Note & one")], NOTES)
    frame = spark.createDataFrame(blocks, BLOCKS).repartition(3)
    bodies = {r.section_id: r.body for r in pages.section_bodies(frame, notes).collect()}
    link = '<sup class="footnote-reference"><a href="#n1" role="doc-noteref" aria-label="Footnote 1">1</a></sup>'
    assert bodies == {
        "s1": f'<p>Law.{link} &amp; page 2</p><section class="box box--case-study" aria-labelledby="x1-title"><h3 id="x1-title">Case &lt;1&gt;</h3><ol start="3"><li value="3">one{link}<ul><li>in</li></ul></li></ol>'
        f'<table id="x3"><caption>Rivers</caption><thead><tr><th scope="col" colspan="2">Head</th></tr></thead><tbody><tr><th scope="row" rowspan="2">side{link}</th><td>a &lt;b&gt;</td></tr></tbody></table></section><h2 id="x4">Next</h2>',
        "s2": "<p>see 1</p>",
    }
    docs = spark.createDataFrame([(1, "T & U", "Press", None, "2020", 3, " ", None), (2, "Bare", "Press", "Sum", None, None, "Here", "Cited")], "doc_id long, title string, publisher string, summary string, published string, pages int, jurisdiction string, citation string")
    sections = spark.createDataFrame([(1, "s1", 0, "Chapter 1", True), (1, "s2", 1, "Index", False)], SECTIONS)
    headings = spark.createDataFrame([(1, "s1", 0, 2, "h0", "First"), (1, "s1", 1, 3, "h1", "Under <it>")], HEADINGS)
    snippets = spark.createDataFrame([(1, 1, "Do that"), (1, 0, "Do this")], "doc_id long, ord int, text string")
    got = {r.doc_id: r.body for r in pages.publication_bodies(docs, sections, headings, frame, notes, snippets).collect()}
    for html in got.values():
        ElementTree.fromstring(f"<div>{html}</div>")
    assert '<article><strong>01</strong><p>Do this</p></article><article><strong>02</strong><p>Do that</p></article>' in got[1] and "<p>This publication presents the reviewed content of T &amp; U.</p>" in got[1]
    assert '<details class="chapter"><summary>Chapter 1</summary><ul><li><a href="#reader-s1">Read full section</a></li><li><a href="#h0">First</a></li></ul></details><div class="section"><a href="#reader-s2">Index</a></div>' in got[1]
    assert '<ul><li><a href="#h0">First</a><ul><li><a href="#h1">Under &lt;it&gt;</a></li></ul></li></ul>' in got[1] and "<span>Previous: Chapter 1</span><span>Next: End of document</span>" in got[1]
    assert "<summary>References and footnotes (1)</summary>" in got[1] and "<blockquote>Press, T &amp; U</blockquote>" in got[1] and "<blockquote>Cited</blockquote>" in got[2] and "0 pages" in got[2]
