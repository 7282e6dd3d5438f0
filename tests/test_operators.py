"""Fixed cases of the operators over tables."""

import pytest
from pyspark.sql import functions as F

from pageloom.operators import audit, blocks, metadata, publication, review, scope, sequential
from pageloom.sources import records
from pageloom.streaming import feed

Z = "0" * 64


def test_chain_status(spark):
    log = spark.createDataFrame([(1, Z, "h1"), (2, "h1", "h2"), (3, "bad", "h3"), (4, "h3", None), (5, "h4", "h5"), (6, "", "h6"), (70, "h6", "h70")], "id long, prev_hash string, entry_hash string")
    expected = {1: "linked", 2: "linked", 3: "broken", 4: "unverifiable", 5: "unverifiable", 6: "unverifiable", 70: "linked"}
    for size in (2, 3, 1000):  # whatever the ranges
        assert {r.id: r.chain_status for r in audit.chain_status(log, size).collect()} == expected
    cut = audit.chain_status(log.where("id > 1")).where("id = 2").first()
    assert cut.chain_status == "unverifiable"


def test_summaries(spark):
    rows = [("upload", '{"file_name":"a.pdf"}', "a.pdf"), ("edit_review_item", '{"items":["x","y"],"resolve_all":true}', "2 items resolved"), ("edit_review_item", '{"resolve_all":true}', "all items resolved"), ("process_failed", '{"file_name":"a","error":"b"}', "a — b"), ("edit_metadata", "{}", "—"), ("other", "{}", "—")]
    df = spark.createDataFrame(rows, "action string, detail string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", audit.entry_summary(F.col("action"), F.col("detail"))).collect())


def test_scope(spark):
    docs = spark.createDataFrame([("a", None), ("b", "me"), ("c", "you")], "id string, uploaded_by string")
    assert {r.id for r in scope.own_documents(docs, "me").collect()} == {"a", "b"}
    assert [r[0] for r in docs.orderBy("id").select(scope.may_change(F.col("uploaded_by"), "me", False)).collect()] == [True, True, False]


def test_thresholds():
    with pytest.raises(ValueError, match="thresholds"):
        review.Thresholds(high=0.5, medium=0.6)


def test_coverage(spark):
    rows = [(1, "t", "title", 0.98), (1, "h1", "section_header_1", 0.95), (1, "h2", "section_header_1", 0.95), (1, "h3", "section_header_2", 0.72), (1, "x", "text", 0.96), (1, "tab", "table", 0.58)]
    made = spark.createDataFrame([(*r, k, "words", 1, False, False) for k, r in enumerate(rows)], "doc_id long, block_id string, label string, confidence double, ord int, text string, page int, has_table boolean, has_bounds boolean")
    at = review.Thresholds(0.85, 0.65)
    items = review.review_queue(made, at)
    assert [(r.item_id, r.band) for r in items.orderBy("original_index").collect()] == [("review-1", "med"), ("review-2", "low")]
    got = {r.category: (r.total, r.detected, r.needs_review) for r in review.coverage(made, items).collect()}
    assert got == {"headings": (3, 2, 1), "tables": (1, 0, 1)}
    assert {r.status for r in review.resolve_all(items).collect()} == {"accepted"}


def test_heading_levels_and_order(spark):
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate([2, 5, 4, 5])], "doc_id long, ord int, level int")
    assert [r.level for r in publication.heading_close_up(rows, ["doc_id"], "ord", "level").orderBy("ord").collect()] == [2, 3, 4, 5]
    parts = spark.createDataFrame([(1, 0, 1, None, "Preface"), (1, 1, 5, 1, "1"), (1, 2, 9, 2, "2"), (1, 3, 12, None, "Appendices"), (1, 4, 15, 3, "Bibliography")], "doc_id long, ord long, page int, seq long, title string")
    placed = publication.interpolated_order(parts).join(parts.select("ord", "title"), "ord").orderBy("position")
    assert [r.title for r in placed.collect()] == ["Preface", "1", "2", "Appendices", "Bibliography"]


def test_sections(spark):
    rows = [(1, 0, 1, 0, "front"), (1, 1, 2, 1, "Chapter 1. Scope"), (1, 2, 3, 1, "1. scope"), (1, 3, 3, 0, "text"), (1, 4, 4, 1, "Next"), (1, 5, 5, 1, "Scope")]
    got = publication.section_table(publication.sections(spark.createDataFrame(rows, "doc_id long, ord int, page int, level int, text string")))
    assert [(r.section, r.title, r.page, r.blocks) for r in got.orderBy("section").collect()] == [(0, "Front matter", 1, 1), (1, "Chapter 1. Scope", 2, 3), (2, "Next", 4, 1), (3, "Scope", 5, 1)]


def test_summary(spark):
    a, b = "This report examines the law of wills in detail.", "It makes forty recommendations to the government."
    rows = spark.createDataFrame([([f"{a} Short one. {a} {b}"], 120), ([f"{a} {b}"], 60), (["word " * 40], 30)], "v array<string>, n int")
    got = [r[0] for n in (120, 60, 30) for r in rows.where(F.col("n") == n).select(publication.summary(F.col("v"), n)).collect()]
    assert got[0] == f"{a} {b}" and got[1] == a and got[2].endswith("word…") and len(got[2]) <= 30


def test_lists_tables_and_order(spark):
    members = spark.createDataFrame([(1, "l", 2, "two", "2.", 3, 0.5), (1, "l", 1, "one", "", 2, None), (1, "l", 3, " ", "", 2, 0.9)], "doc_id long, list_id string, ord int, text string, marker string, page int, confidence double")
    r = blocks.list_blocks(members).first()
    assert (r.text, r.page, r.confidence) == ("• one\n2. two", 2, 0.5)
    cells = spark.createDataFrame([(1, "t", 0, 0, "A", True, 0), (1, "t", 0, 1, "B", False, 1), (1, "t", 1, 1, "x", False, 2), (1, "t", 1, 1, "y", False, 3)], "doc_id long, table_id string, row int, col int, text string, is_header boolean, ord int")
    t = blocks.tables_from_cells(cells).first()
    assert (t.headers, t.rows) == (["A", "B"], [["", "y"]])
    items = spark.createDataFrame([(1, "a", "texts", 0, 1), (1, "b", "texts", 1, 1), (1, "g", "groups", 0, 1), (1, "p", "pictures", 0, 2)], "doc_id long, ref string, collection string, ord int, page int")
    edges = spark.createDataFrame([(1, "g", "h"), (1, "h", "b"), (1, "h", "g")], "doc_id long, parent string, child string")
    assert [r.ref for r in blocks.reading_order(items, edges).orderBy("position").collect()] == ["a", "g", "b", "p"]


def test_main_title(spark):
    rows = [("x", "section_header", "Contents", 1, 1, 0), ("y", "section_header", "A Review of the Law of Wills", 1, 1, 1), ("z", "title", "Law", 1, None, 2), ("w", "title", "A Review of Everything at Once", 9, 1, 3)]
    items = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, ref string, label string, text string, page int, level int, position int")
    assert blocks.main_title(items.withColumn("excluded", F.lit(False))).first().ref == "z"
    assert blocks.main_title(items.where("label <> 'title'").withColumn("excluded", F.lit(False))).first().ref == "y"


def test_metadata(spark):
    lines = [(1, 1, 0, "TITLE: The Law of Wills"), (1, 1, 1, "THE LAW OF WILLS"), (1, 2, 2, "Final Report: May 2011"), (1, 2, 3, "Published by the Wills Office. Copyright"), (1, 3, 4, "Wills Act 1997 (Vic); Reed v Smith [2001] VSC 3"), (1, 3, 5, "The Wills Act 1997 (Vic)")]
    df = spark.createDataFrame(lines, "doc_id long, page int, pos long, line string")
    t = metadata.titles(df, spark.createDataFrame([], "doc_id long, title string"), "Wills Office").first()
    assert (t.title, t.method) == ("The Law of Wills", "labelled")
    assert metadata.dates_of(df).first().value == "2011-05"
    p = metadata.publishers(df, "Wills Office").first()
    assert (p.value, p.method, p.confidence) == ("Wills Office", "published_by", 0.98)
    c = metadata.citations(df).first()
    assert c.found == 2 and c.citations == "Wills Act 1997 (Vic); Reed v Smith [2001] VSC 3" and c.confidence == 0.71
    assert metadata.jurisdictions(df).first().value == "Victoria, Australia"


def test_sequential_functions():
    assert sequential.clusters([1, 2, 9, 3, 10], 3) == [2.0, 9.5]
    assert sequential.column_starts([10, 12, 300, 310], 600) == [11.0, 305.0]
    assert sequential.merged_boxes([(0, 0, 100, 10), (0, 14, 100, 20), (0, 60, 100, 70), (200, 0, 300, 9)]) == [(0, 0, 100, 20), (200, 0, 300, 9), (0, 60, 100, 70)]
    assert sequential.list_tree([1, 3, 2, 1, 2]) == [(0, -1), (1, 0), (1, 0), (0, -1), (1, 3)]
    assert sequential.similarity({"law of wills"}, {"the law of wills"}) == pytest.approx(24 / 28)
    assert sequential.linked_footnotes("Law.1 See page 2, 1st and 3.1 & 2 2", {"1": "footnote-1", "2": "n2"}).count("<sup") == 2


def test_callouts(spark):
    blocks = [("before", "text", "x", 0.9, 100.0, False), ("heading", "section_header_3", "Case study", 0.8, 10.0, False), ("outline", "section_header_1", "Chapter 1", 0.1, 15.0, True), ("in", "text", "inside", 0.6, 20.0, None), ("later", "section_header_3", "One of them", 0.5, 60.0, False)]
    made = spark.createDataFrame([(1, 1, b, k, label, t, c, 5.0, y, d) for k, (b, label, t, c, y, d) in enumerate(blocks)], "doc_id long, page int, block_id string, order long, label string, text string, confidence double, x double, y double, toc_derived boolean")
    # the second region holds nothing that the first leaves but one heading; the third has a heading and something after it
    regions = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 50.0), (1, 1, 1, 0.0, 0.0, 10.0, 70.0)], "doc_id long, page int, region long, l double, t double, r double, b double")
    got = {r.block_id: (r.parent, r.label, r.place, r.confidence) for r in sequential.page_callouts(made, regions).collect()}
    assert got == {"before": (None, "text", 0, 0.9), "box-section:heading": (None, "box_section", 1, 0.6), "outline": (None, "section_header_1", 2, 0.1), "in": ("box-section:heading", "text", None, 0.6), "later": (None, "section_header_3", 3, 0.5)}
    assert sequential.page_callouts(made, regions.limit(0)).where("parent is not null").count() == 0


def test_regions_take_blocks_in_turn():
    claim = lambda region, block, heads=False, named=True: (1, 1, region, block, heads, named)
    claims = [claim(0, "a"), claim(0, "b", True), claim(1, "b", True), claim(1, "c"), claim(1, "d", True), claim(2, "c"), claim(2, "d", True), claim(2, "e"), claim(3, "f", True, False), claim(3, "g")]
    assert [x[2:] for x in sequential.taken_by_regions(claims)] == [("b", "b"), ("c", "b"), ("d", "b")]


def test_greedy_match(spark):
    entries = spark.createDataFrame([(1, 0, "1. Scope of the Law", 3), (1, 1, "Scope of the Laws", None), (1, 2, "Glossary", 50)], "doc_id long, entry long, title string, target int")
    items = spark.createDataFrame([(1, "a", 0, 2, "section_header", "Scope of the law"), (1, "b", 1, 9, "section_header", "Scope of the laws"), (1, "c", 2, 4, "text", "Scope of something"), (1, "d", 3, 20, "text", "Glossary")], "doc_id long, ref string, order long, page int, label string, text string")
    assert {(r.entry, r.ref) for r in sequential.match_entries(entries, items).collect()} == {(0, "a"), (1, "b"), (2, "d")}


def test_records(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "record.json").write_text('{"id": "a", "title": "A", "created_at": 2.0, "job": {"state": "idle"}}')
    (tmp_path / "b" / "record.json").write_text("{broken")
    found = records.read_records(spark, str(tmp_path))
    assert [r.id for r in found.collect()] == ["a"]
    changes = spark.createDataFrame([("a", None, "P"), ("n", "N", None)], "id string, title string, publisher string")
    got = {r.id: (r.title, r.publisher) for r in records.upserted(found, changes).collect()}
    assert got == {"a": ("A", "P"), "n": ("N", None)}
    assert records.created(found, changes.select("id")).count() == 1 and records.deleted(found, changes.select("id")).count() == 0


def test_upload_checks(spark, tmp_path):
    (tmp_path / "ok.pdf").write_bytes(b"junk %PDF-1.4")
    (tmp_path / "no.pdf").write_bytes(b"text")
    (tmp_path / "x.txt").write_bytes(b"%PDF-")
    got = {r.path.rsplit("/")[-1]: r.reason for r in records.uploads(spark, str(tmp_path)).collect()}
    assert got == {"ok.pdf": None, "no.pdf": "415 not a pdf", "x.txt": "415 not a pdf name"}


def test_streams(spark, tmp_path):
    from pageloom.operators import telemetry

    jobs = [(k % 3, k, 10 + k, 50.0 + 7 * k) for k in range(30)]
    schema = "group_id long, at long, pages long, seconds double"
    for part in range(3):
        spark.createDataFrame(jobs[part * 10 : part * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = feed.follow(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    feed.append(source, str(tmp_path / "copy"), str(tmp_path / "c1")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 30
    rates = feed.running_rates(source).writeStream.format("memory").queryName("rates").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    rates.awaitTermination(90)
    got = {r.group_id: r.samples for r in spark.table("rates").collect()}
    batch = {r.group_id: r for r in telemetry.running_rates(spark.createDataFrame(jobs, schema), "group_id", "at").collect()}
    assert got == {g: r.samples for g, r in batch.items()}
    last = {r.group_id: r.seconds_per_page for r in spark.table("rates").collect()}
    assert last == {g: pytest.approx(r.seconds_per_page, abs=1e-4) for g, r in batch.items()}


def test_contents_pages(spark):
    from pageloom.operators import hierarchy

    rows = [(1, 1, 0, "Title")]
    rows += [(1, 2, 0, "Contents"), (1, 2, 1, "Scope .... 1"), (1, 2, 2, "Law .... 4"), (1, 2, 3, "Scope .... 1"), (1, 2, 4, "Ends .... ix")]
    rows += [(1, 3, k, f"Part {'abcdefg'[k]} .... {k + 10}") for k in range(5)]
    rows += [(1, 5, k, f"Late {'abcdefg'[k]} .... {k + 20}") for k in range(5)]
    lines = spark.createDataFrame(rows, "doc_id long, page int, pos int, text string")
    pages = hierarchy.contents_pages(lines)
    assert {r.page for r in pages.collect()} == {2, 3}
    entries = hierarchy.contents_entries(lines, pages).orderBy("sequence").collect()
    assert [r.title for r in entries][:3] == ["Scope", "Law", "Ends"] and len(entries) == 8
    numbers = spark.createDataFrame([("12",), ("ix",), ("abc",)], "p string").select(hierarchy.printed_number(F.col("p"))).collect()
    assert [r[0] for r in numbers] == [12, 9, None]


def test_outline_mending(spark):
    from pageloom.operators import hierarchy

    rows = [(1, 0, "One", 1, 1, True), (1, 1, "a", 2, None, False), (1, 2, "Two", 2, None, True), (1, 3, "Three", 2, None, True), (1, 4, "Four", 1, 3, True), (1, 5, "b", 2, None, True)]
    got = hierarchy.mended_gaps(spark.createDataFrame(rows, "doc_id long, sequence int, title string, level int, number int, prominent boolean")).orderBy("sequence").collect()
    assert [(r.title, r.level) for r in got] == [("One", 1), ("a", 2), ("Chapter 2: Two", 1), ("Three", 2), ("Four", 1), ("b", 2)]
    chapters = spark.createDataFrame([(1, 1, 10, "x"), (1, 3, 30, "y"), (1, 3, 20, "z")], "doc_id long, number int, page int, title string")
    assert [(r.number, r.page, r.title) for r in hierarchy.chapters_once(chapters).orderBy("number").collect()] == [(1, 10, "x"), (3, 20, "z")]
    assert not hierarchy.numbers_complete(chapters).first().complete
    entries = spark.createDataFrame([(1, k, 1, t, False) for k, t in enumerate([5, 11, 15, 25, 40])], "doc_id long, sequence int, level int, target int, is_chapter boolean")
    assert [r.level for r in hierarchy.demoted_inside(entries, chapters).orderBy("sequence").collect()] == [1, 1, 2, 2, 1]
    heads = spark.createDataFrame([(1, 0, 1, "A"), (1, 1, 1, "a"), (1, 2, 2, "A"), (1, 3, 2, "."), (1, 4, 2, ".")], "doc_id long, ord int, page int, text string")
    assert hierarchy.first_headings(heads).count() == 4


def test_outline_levels(spark):
    from pageloom.operators import hierarchy

    rows = [("Preface", 1, 50, "i"), ("1. Scope", 1, 50, "1"), ("Terms", 1, 70, "2"), ("Deeper", 2, 90, "3"), ("Recommendations", 1, 50, "4"), ("2. Law", 1, 50, "5"), ("Glossary", 1, 80, "6"), ("Appendix A Lists", 1, 50, "7"), ("Appendix B More", 1, 50, "8"), ("Index", 1, 50, "9")]
    df = spark.createDataFrame([(1, k, t, n, float(x), p, False) for k, (t, n, x, p) in enumerate(rows)], "doc_id long, sequence int, title string, level int, indent double, printed string, prominent boolean")
    got = [(r.title, r.level) for r in hierarchy.outline_levels(df).orderBy("sequence").collect()]
    assert got == [("Preface", 1), ("1. Scope", 1), ("Terms", 3), ("Deeper", 3), ("Recommendations", 2), ("2. Law", 1), ("Glossary", 1), ("Appendices", 1), ("Appendix A Lists", 2), ("Appendix B More", 2), ("Index", 1)]


def test_boxes_of_pages(spark):
    rows = [(d, 1, 0.0, 20.0 * k + d, 100.0, 20.0 * k + d + 14) for d in range(50) for k in range(4)]
    rows += [(99, p, 0.0, 0.0, 10.0, 5.0) for p in range(3)]
    merged = sequential.per_page(spark.createDataFrame(rows, "doc_id long, page int, l double, t double, r double, b double"), sequential.merged_boxes).collect()
    assert len(merged) == 53 and all((r.t, r.b) == (r.doc_id, r.doc_id + 74.0) for r in merged if r.doc_id < 50)


def test_change_rows_of_all_orders(spark, tmp_path):
    from pageloom.plans import audit_queries

    spark.createDataFrame([(k, "1-URGENT", "O", 10 * k) for k in range(1, 8)], "o_orderkey long, o_orderpriority string, o_orderstatus string, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {tuple(r) for r in audit_queries.audit_change_rows(spark, str(tmp_path)).select("id", "field", "before_value", "after_value").collect()}
    assert got == {(k, "title", "1-URGENT", "1-urgent") for k in range(1, 8)} | {(k, "citations", None, str(10 * k)) for k in range(1, 8)}
