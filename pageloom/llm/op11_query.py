"""op11_vector_codes: product codes of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import table
from pageloom.llm.vector_codes import Codebooks, compress, with_label_errors


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    digest = (books or Codebooks([])).sha256()
    return with_label_errors(coded).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _assigned(books: str) -> str:
    """The parts with their nearest entry and its distance."""
    return f"""
  SELECT vec_id, part, c, min(d * 64 + entry) % 64 AS entry, min(d * 64 + entry) // 64 AS d
  FROM (SELECT p.vec_id, p.part, p.c, b.entry, list_sum([(p.c[i] - b.c[i]) * (p.c[i] - b.c[i]) FOR i IN range(1, len(p.c) + 1)])::BIGINT AS d
        FROM parts p JOIN {books} b ON b.part = p.part)
  GROUP BY vec_id, part, c"""


def _updated(books: str, near: str) -> str:
    """The books with the floors of means; entries without parts stay."""
    return f"""
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c
  FROM {books} b LEFT JOIN (
    SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c
    FROM (SELECT part, entry, i, sum(c[i])::BIGINT AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM {near}) GROUP BY part, entry, i)
    GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry"""


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLES = {
    "op11_vector_codes": f"""
WITH vectors AS (
  SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT vec_id, k AS part, q[k * (len(q) // 16) + 1:(k + 1) * (len(q) // 16)] AS c FROM vectors, (SELECT unnest(range(16)) AS k)),
books0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, c FROM parts QUALIFY entry < 64),
near1 AS ({_assigned("books0")}),
books1 AS ({_updated("books0", "near1")}),
near2 AS ({_assigned("books1")}),
books2 AS ({_updated("books1", "near2")}),
near3 AS ({_assigned("books2")}),
codes AS (SELECT vec_id, string_agg(lower(lpad(hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near3 GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(x, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, c[i]::VARCHAR AS x, i FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM books2)))
SELECT codes.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN vectors ON vectors.vec_id = codes.vec_id, digest"""
}
