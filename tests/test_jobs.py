"""Jobs in stages, checked audit streams, and small pieces that no query shows."""

import pytest
from pyspark.sql import functions as F

from pageloom.functions import display, geometry
from pageloom.functions.text import bare_lines
from pageloom.operators import blocks, rendering, review
from pageloom.sources import records
from pageloom.streaming import feed, jobs


def test_stages_and_stopping(spark):
    seen = []
    job = jobs.Job(spark, "job-1", lambda step, message: seen.append((step, message)))
    stages = [("count", lambda _: spark.range(10).count()), ("double", lambda n: 2 * n)]
    assert job.run(stages) == 20 and seen == [(0, "count"), (1, "double"), (2, "done")]
    assert job.running() == [] and spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    stopped = jobs.Job(spark, "job-2")
    done = []
    with pytest.raises(jobs.Stopped):
        stopped.run([("first", lambda _: (done.append(1), stopped.cancel())), ("second", lambda _: done.append(2))])
    assert done == [1]


def test_checked_audit_stream(spark, tmp_path):
    """The chain is followed across batches; a broken link shows, and each entry is there once."""
    rows = [(k, f"h{k}", "0" * 64 if k == 0 else "other" if k == 7 else f"h{k - 1}") for k in range(12)]
    for part in range(3):
        spark.createDataFrame(rows[4 * part : 4 * part + 4], "id long, entry_hash string, prev_hash string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = feed.follow(spark, str(tmp_path / "in"), schema, files=1)
    listener = jobs.ProgressListener()
    spark.streams.addListener(listener)
    feed.append_checked(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    spark.streams.removeListener(listener)
    got = [(r.id, r.chain_status) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()]
    assert got == [(k, "broken" if k == 7 else "linked") for k in range(12)]


def test_chain_state_over_restarts_and_late_entries(spark, tmp_path):
    """Each start goes on from the row that the last batch has left; the table that has been written isn't read, and late entries are told."""
    schema = "id long, entry_hash string, prev_hash string"
    batches = [[0, 1, 2], [3, 5], [4, 6], [], [7]]
    for n, ids in enumerate(batches):
        rows = [(k, f"h{k}", "0" * 64 if k == 0 else f"h{3 if k == 5 else 5 if k == 6 else k - 1}") for k in ids]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))
        stream = feed.follow(spark, str(tmp_path / "in" / "part=*"), spark.createDataFrame([], schema).schema)
        feed.append_checked(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
        if n == 1:  # what is in the table is no part of the state
            (tmp_path / "out" / "batch=0").rename(tmp_path / "moved")
    (tmp_path / "moved").rename(tmp_path / "out" / "batch=0")
    got = [(r.id, r.chain_status) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()]
    assert got == [(k, "late" if k == 4 else "linked") for k in range(8)]


def test_patches_of_unknown_items_are_refused(spark):
    items = spark.createDataFrame([(1, "a", "text", "pending"), (2, "a", "text", "pending")], "doc_id long, item_id string, type string, status string")
    patches = spark.createDataFrame([(1, "a", None, None, "new"), (1, "zz", "accepted", None, None), (2, "a", "accepted", None, None)], "doc_id long, item_id string, status string, type string, corrected_text string")
    once = review.apply_patches(items, patches)
    assert sorted((r.doc_id, r.status, r.corrected_text) for r in once.collect()) == [(1, "pending", None), (2, "accepted", None)]
    again = review.apply_patches(once, spark.createDataFrame([(2, "a", None, None, "text")], patches.schema))
    more = review.apply_patches(again, spark.createDataFrame([(2, "a", "accepted", None, None)], patches.schema))
    assert [r.corrected_text for r in more.where("doc_id = 2").collect()] == ["text"]


def test_nested_markup():
    items = [{"text": "One 1", "level": 1, "ordered": True, "value": 4}, {"text": "In", "level": 2, "ordered": False, "value": None}, {"text": "Two & more", "level": 1, "ordered": True, "value": 5}, {"text": "Plain", "level": 1, "ordered": False, "value": None}]
    assert rendering.nested_items(items, True, 4, {}) == '<ol start="4"><li value="4">One 1<ul><li>In</li></ul></li><li value="5">Two &amp; more</li></ol><ul><li>Plain</li></ul>'


def test_names_and_levels(spark):
    row = spark.createDataFrame([(1, None, -2, 3)], "published_date int, a int, b int, c int")
    assert display.with_camel_names(row).columns == ["publishedDate", "a", "b", "c"]
    assert row.select(blocks.list_level(F.col("a"), F.col("b"), F.col("c"))).first()[0] == 0 and row.select(blocks.list_level(F.col("a"), F.col("c"))).first()[0] == 3
    with pytest.raises(ValueError):
        records.artifacts_deleted(row, row, ("../x",))


def test_measures_of_lines(spark):
    row = spark.createDataFrame([("• a\n\n- b \n c", 5.0, 842.0), (None, 5.0, 0.0)], "text string, t double, height double")
    b = geometry.box(F.lit(0), F.col("t"), F.lit(1), F.lit(15))
    got = [tuple(r) for r in row.select(bare_lines(F.col("text")), geometry.middle(b), geometry.top_ratio(b, F.col("height"))).collect()]
    assert got == [(["a", "b", "c"], 10.0, 5 / 842), ([], 10.0, 1.0)]
