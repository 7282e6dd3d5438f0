"""op12_filter_audit: five filters over all documents in all 120 orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm.common import table
from pageloom.llm.filter_audit import audit


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(*columns)


QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLES = {
    "op12_filter_audit": r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
flags AS (
  SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         doc_id > min(doc_id) OVER (PARTITION BY text) AS e,
         coalesce((SELECT bool_or(quality = 1) FROM labels WHERE labels.doc_id = docs.doc_id), FALSE) AS good,
         coalesce((SELECT bool_or(toxic = 1) FROM labels WHERE labels.doc_id = docs.doc_id), FALSE) AS toxic
  FROM docs),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS o FROM letters v, letters w, letters x, letters y, letters z
  WHERE len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5),
steps AS (SELECT o, s, o[s] AS f FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
failed AS (
  SELECT doc_id, part, good, toxic,
         CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails
  FROM flags),
seen AS (
  SELECT part, good, toxic, fails, o, s, f, contains(fails, f) AS now,
         len(regexp_extract_all(left(o, s - 1), '[' || fails || '_]')) > 0 AS before
  FROM failed, steps),
counted AS (
  SELECT part, o, s, f, count(*) FILTER (NOT now AND NOT before) AS kept, count(*) FILTER (now AND NOT before) AS removed, count(*) FILTER (now AND before) AS redundant,
         count(*) FILTER (fails = f) AS unique_fails, count(*) FILTER (now AND NOT before AND good) AS good_lost, count(*) FILTER (now AND NOT before AND toxic) AS toxic_lost
  FROM seen GROUP BY part, o, s, f)
SELECT part, o AS filter_order, s::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted"""
}
