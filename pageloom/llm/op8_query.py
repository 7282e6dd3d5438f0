"""op8_url_filter: verdicts on every page's URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import table
from pageloom.llm.url_filter import judge_urls

#: Fixed rules of the query: verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in longest)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in longest)
    return f"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM parts"""


def url_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by the same rules and a list of URLs: those of casino hosts, written otherwise than on the pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(F.contains("url", F.lit("casino"))).select(F.concat(F.upper(F.regexp_extract("url", "^[^:]*://[^/?#]*", 0)), F.lit(":443"), F.regexp_extract("url", "^[^:]*://[^/?#]*([^#]*)", 1), F.lit("#listed")).alias("url"))
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge_urls(pages, rules, listed=listed).select("page_id", "rule", "verdict")


QUERIES = {"op8_url_filter": op8_url_filter, "url_blocklist": url_blocklist}
ORACLES = {
    "op8_url_filter": _oracle(),
    "url_blocklist": f"""
WITH judged AS ({_oracle()}),
forms AS (SELECT page_id, url LIKE '%casino%' AS listed, regexp_replace(regexp_replace(url, '#.*$', '', 's'), '^[a-z]+://', '') AS form FROM pages)
SELECT judged.page_id, rule, CASE WHEN rule IS NULL AND form IN (SELECT form FROM forms WHERE listed) THEN 'block' ELSE verdict END AS verdict
FROM judged JOIN forms ON forms.page_id = judged.page_id""",
}
