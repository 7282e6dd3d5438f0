"""Edits of a review, merged changes, and what can be reached from a node."""

import os

from pyspark.sql import functions as F

from pageloom.operators import blocks, edits, review
from pageloom.sources import records

ITEMS = f"doc_id long, item_id string, block_id string, type string, status string, corrected_text string, corrected_table {edits.TABLE}"
BLOCKS = f"doc_id long, block_id string, label string, text string, table_data {edits.TABLE}, list_entries {edits.ENTRIES}, box_title string, box_kind string, children {edits.CHILDREN}, removed boolean"
PATCHES = f"doc_id long, item_id string, status string, type string, corrected_text string, corrected_table {edits.TABLE}, ord int"


def tables(spark, docs):
    items = [(d, f"i{k}", f"b{k}", label, "pending", None, None) for d in docs for k, label in enumerate(("text", "list", "box_section"))]
    made = [(d, f"b{k}", label, f"one {k}\ntwo", None, None, "Case" if k == 2 else None, "case_study" if k == 2 else None, [("text", "first"), ("text", "second")] if k == 2 else None, False) for d in docs for k, label in enumerate(("text", "list", "box_section"))]
    approved = spark.createDataFrame([(d, "2024") for d in docs], "id long, approved_at string")
    artifacts = spark.createDataFrame([(d, name, "x") for d in docs for name in ("source.pdf", "publication.json")], "document_id long, name string, value string")
    return edits.Edited(spark.createDataFrame(items, ITEMS), spark.createDataFrame(made, BLOCKS), approved, artifacts)


def test_patches_merge_in_order(spark):
    items = tables(spark, [1]).items
    patches = spark.createDataFrame([(1, "i0", "removed", None, None, None, 1), (1, "i0", None, "list", None, None, 3), (1, "i0", None, "table", "late", None, 2)], PATCHES)
    got = [(r.status, r.type, r.corrected_text, r.removed) for r in review.apply_patches(items, patches).where("item_id = 'i0'").collect()]
    assert got == [("edited", "list", "late", False)]
    assert review.apply_patches(items, patches.drop("ord")).count() == 3  # in the order of their values, still one row an item
    last = patches.where("ord < 2").union(spark.createDataFrame([(1, "i0", "accepted", None, None, None, 9)], PATCHES))
    assert [r.status for r in review.apply_patches(items, last).where("item_id = 'i0'").collect()] == ["accepted"]


def test_changes_of_one_record_merge_in_order(spark):
    old = spark.createDataFrame([("a", "A", "P"), ("b", "B", None)], "id string, title string, publisher string")
    changes = spark.createDataFrame([("a", "second", None, 2), ("a", "first", "Q", 1), ("n", None, "N", 1), ("n", "new", None, 2)], "id string, title string, publisher string, ord int")
    assert sorted(tuple(r) for r in records.upserted(old, changes).collect()) == [("a", "second", "Q"), ("b", "B", None), ("n", "new", "N")]
    assert records.upserted(old, changes.drop("ord")).count() == 3


def test_edits_of_items_blocks_and_outputs(spark):
    patches = [(1, "i0", None, "table", None, (["h", "i"], [["1", "2"]]), 1), (1, "i1", None, "box_section", "boxed", None, 1), (1, "i2", None, None, "ignored, as it holds two", None, 1), (1, "i2", "removed", None, None, None, 2), (2, "i0", "accepted", None, "x", None, 1), (2, "none", "accepted", None, None, None, 2)]
    after = edits.edited(*tables(spark, [1, 2, 3]), spark.createDataFrame(patches, PATCHES))
    got = {(r.doc_id, r.block_id): r for r in after.blocks.collect()}
    table, box, held = got[1, "b0"], got[1, "b1"], got[1, "b2"]
    assert (table.label, table.text, table.table_data.headers, table.removed) == ("table", "h | i\n1 | 2", ["h", "i"], False)
    assert (box.label, box.text, box.box_title, box.box_kind, [tuple(c) for c in box.children]) == ("box_section", "boxed", "Box Section", "information", [("list", "boxed")])
    assert (held.text, held.box_title, held.removed, len(held.children)) == ("first\n\nsecond", "Case", True, 2)
    assert got[2, "b0"].text == "one 0\ntwo" and got[3, "b2"].box_title == "Case"  # a patch of an unknown item refuses the document's patches
    items = {(r.doc_id, r.item_id): (r.type, r.status, r.corrected_text, r.corrected_table is not None) for r in after.items.collect()}
    assert items[1, "i0"] == ("table", "edited", None, True) and items[1, "i1"] == ("box_section", "edited", "boxed", False) and items[1, "i2"] == ("box_section", "removed", "first\n\nsecond", False)
    assert items[2, "i0"] == ("text", "pending", None, False)
    assert {r.id: r.approved_at for r in after.records.collect()} == {1: None, 2: "2024", 3: "2024"}
    assert sorted(tuple(r)[:2] for r in after.artifacts.collect()) == [(1, "source.pdf"), (2, "publication.json"), (2, "source.pdf"), (3, "publication.json"), (3, "source.pdf")]


def test_only_touched_buckets_are_written(spark, tmp_path):
    path, docs = str(tmp_path / "store"), list(range(12))
    edits.write_tables(tables(spark, docs), path, 5)
    files = lambda name: {d: sorted(os.listdir(f"{path}/{name}/{d}")) for d in os.listdir(f"{path}/{name}") if d.startswith("bucket=")}
    before = {name: files(name) for name in edits.TABLES}
    patches = spark.createDataFrame([(3, "i0", None, None, "new words", None, 1), (3, "i0", "accepted", None, None, None, 2)], PATCHES)
    touched = edits.edit_stored(spark, path, patches, 5)
    assert len(touched) == 1
    for name in edits.TABLES:
        changed = {d for d, own in files(name).items() if own != before[name][d]}
        assert changed == {f"bucket={touched[0]}"}
    again = edits.stored(spark, path)
    assert {c: getattr(again, c).count() for c in edits.TABLES} == {"items": 36, "blocks": 36, "records": 12, "artifacts": 23}
    assert [(r.text, r.removed) for r in again.blocks.where("doc_id = 3 and block_id = 'b0'").collect()] == [("new words", False)]
    assert again.records.where("approved_at is null").count() == 1 and again.items.where("status = 'accepted'").count() == 1
    assert edits.edit_stored(spark, path, patches.limit(0), 5) == []


def test_descendants_at_any_depth(spark):
    chain = [(1, f"n{k}", f"n{k + 1}") for k in range(1000)]
    others = [(2, "a", "b"), (2, "b", "c"), (2, "c", "a"), (2, "a", "a"), (2, "x", "c"), (2, "x", "c")]
    found = blocks.descendants(spark.createDataFrame(chain + others, "doc_id long, parent string, child string"))
    assert found.where("doc_id = 1").count() == 1000 * 1001 // 2 and found.where("top = 'n0'").count() == 1000
    assert sorted((r.top, r.ref) for r in found.where("doc_id = 2").collect()) == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b"), ("x", "a"), ("x", "b"), ("x", "c")]
    assert blocks.descendants(spark.createDataFrame([], "doc_id long, parent string, child string")).count() == 0


def test_order_by_the_first_text_far_below(spark):
    texts = [(1, f"t{k}", "texts", k, 1) for k in range(3)]
    groups = [(1, f"g{k}", "groups", k, 1) for k in range(40)]
    items = spark.createDataFrame(texts + groups, "doc_id long, ref string, collection string, ord long, page int")
    edges = spark.createDataFrame([(1, f"g{k}", f"g{k + 1}") for k in range(39)] + [(1, "g39", "t1")], "doc_id long, parent string, child string")
    order = [r.ref for r in blocks.reading_order(items, edges).orderBy("position").collect()]
    assert order[0] == "t0" and order[-2:] == ["t1", "t2"] and set(order[1:41]) == {f"g{k}" for k in range(40)}
