"""op3_license_scan: canonical digests of all documents and the licences found by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm import licenses
from pageloom.llm.common import table


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", "digest", "license", "notices")


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '{licenses.COPYRIGHT_LINES}', ' ', 'g')"
    for spelling, usual in licenses.SPELLINGS.items():
        out = f"replace({out}, '{spelling}', '{usual}')"
    return f"trim(regexp_replace({out}, '{licenses.MARKS}', ' ', 'g'))"


def _oracle() -> str:
    quoted = lambda rows: ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in rows)
    digest = lambda text: f"CASE WHEN {_canonical(text)} <> '' THEN sha256({_canonical(text)}) END"
    known = lambda rows: f"SELECT {digest('t')} AS digest, min(n) AS license FROM (VALUES {quoted(rows)}) k(n, t) GROUP BY 1"
    listed = ", ".join(f"('{n}', '{d}')" for n, d in licenses.DIGESTS)
    return f"""
WITH whole AS (SELECT digest, min(license) AS license FROM ({known(licenses.LICENSES + licenses.NOTICES)} UNION ALL SELECT d, n FROM (VALUES {listed}) k(n, d)) GROUP BY 1),
notice AS ({known(licenses.NOTICES)}),
lines AS (SELECT doc_id, unnest(list_distinct(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents),
named AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT doc_id, {digest('line')} AS digest FROM lines) JOIN notice USING (digest) GROUP BY doc_id),
docs AS (SELECT doc_id, {digest('text')} AS digest FROM documents)
SELECT docs.doc_id, docs.digest, whole.license, named.notices
FROM docs LEFT JOIN whole USING (digest) LEFT JOIN named ON named.doc_id IS NOT DISTINCT FROM docs.doc_id"""


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLES = {"op3_license_scan": _oracle()}
