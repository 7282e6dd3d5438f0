"""op1_minhash_dedup: near-duplicate groups of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm.common import table
from pageloom.llm.minhash_dedup import find_components


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_components(table(spark, sf_dir, "documents"))


QUERIES = {"op1_minhash_dedup": op1_minhash_dedup}
ORACLES = {
    "op1_minhash_dedup": r"""
WITH RECURSIVE
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
members AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k
  FROM members a JOIN members b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM shared JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v
  WHERE 100 * k >= 75 * (a.n + b.n - k)),
reach AS (
  SELECT doc_id, doc_id AS r FROM sizes
  UNION
  SELECT reach.doc_id, links.v FROM reach JOIN links ON links.u = reach.r)
SELECT sizes.doc_id, n AS n_shingles, min(r) AS component_id, sizes.doc_id = min(r) AS kept
FROM sizes JOIN reach ON reach.doc_id = sizes.doc_id GROUP BY sizes.doc_id, n"""
}
