"""Inputs that the named queries derive from the given tables: the same rules in DataFrame form and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: events as an audit log. The hashes are made up of ids, so that no window is needed to know the one before;
#: every 97th link is broken and every 89th hash is missing.
AUDIT_SQL = """
SELECT event_id AS id,
       'doc-' || CAST(event_id % 40 AS STRING) AS document_id,
       CAST(user_id AS STRING) AS actor_id,
       'user' || CAST(user_id AS STRING) || '@example.com' AS actor_email,
       CASE event_type WHEN 'signup' THEN 'upload' WHEN 'view' THEN 'edit_review_item' WHEN 'click' THEN 'edit_metadata'
                       WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'process_failed' ELSE event_type END AS action,
       CASE event_type WHEN 'signup' THEN '{"file_name":"file-' || CAST(user_id AS STRING) || '.pdf","pages":' || CAST(event_id % 300 AS STRING) || '}'
                       WHEN 'view' THEN '{"item":"item ' || CAST(event_id % 7 AS STRING) || '"}'
                       WHEN 'click' THEN '{"title":"Title ' || CAST(event_id % 11 AS STRING) || '"}'
                       WHEN 'error' THEN '{"file_name":"file-' || CAST(user_id AS STRING) || '.pdf","error":"timeout"}'
                       ELSE '{}' END AS detail,
       CASE WHEN event_id % 89 = 0 THEN NULL ELSE SHA256_OF('entry-' || CAST(event_id AS STRING)) END AS entry_hash,
       CASE WHEN event_id = 0 THEN '0000000000000000000000000000000000000000000000000000000000000000'
            WHEN event_id % 97 = 0 THEN SHA256_OF('other')
            ELSE SHA256_OF('entry-' || CAST(event_id - 1 AS STRING)) END AS prev_hash,
       ts AS created_at
FROM events"""

#: customers as document records.
RECORDS_SQL = """
SELECT 'doc-' || CAST(c_custkey AS STRING) AS id, c_name AS title,
       lower(c_mktsegment) || '-' || CAST(c_custkey AS STRING) || '.pdf' AS file_name,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'user' || CAST(c_nationkey AS STRING) END AS uploaded_by,
       CASE c_custkey % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE NULL END AS state,
       CASE WHEN c_custkey % 8 = 0 THEN '2024-05-01' END AS approved_at,
       c_custkey % 3 <> 0 AS metadata_confirmed,
       CASE WHEN c_custkey % 6 = 0 THEN ' ' ELSE c_mktsegment END AS publisher,
       c_custkey AS record_key, c_acctbal
FROM customer"""

#: lines of order items as blocks of documents.
BLOCKS_SQL = """
SELECT l_orderkey AS doc_id, 'b' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS block_id,
       CASE (l_partkey + l_linenumber) % 8 WHEN 0 THEN 'section_header_1' WHEN 1 THEN 'section_header_2' WHEN 2 THEN 'text' WHEN 3 THEN 'table'
            WHEN 4 THEN 'picture' WHEN 5 THEN 'header' WHEN 6 THEN 'list' ELSE 'document_index' END AS label,
       CASE WHEN l_suppkey % 9 = 0 THEN ' ' ELSE l_returnflag || l_linestatus || ' part ' || CAST(l_partkey AS STRING) END AS text,
       CAST(l_linenumber AS INT) AS page,
       CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_tax * 10 + l_discount END AS confidence,
       (l_linenumber * 1000000 + l_partkey) * 1000 + l_suppkey AS ord,
       l_partkey % 5 = 0 AS has_table, l_partkey % 3 = 0 AS has_bounds
FROM lineitem"""


def derived(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """The Spark form of one of the statements above."""
    text = sql.replace("SHA256_OF(", "sha2_256(")
    while "sha2_256(" in text:
        at = text.index("sha2_256(") + len("sha2_256(")
        depth, end = 1, at
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = text[: at - len("sha2_256(")] + "sha2(" + text[at : end - 1] + ", 256)" + text[end:]
    view = f"pageloom_{name}"
    table(spark, sf_dir, name).createOrReplaceTempView(view)
    return spark.sql(text.replace(f"FROM {name}", f"FROM {view}"))


def duck(sql: str) -> str:
    """The DuckDB form of one of the statements above."""
    return sql.replace("SHA256_OF(", "sha256(").replace("AS STRING)", "AS VARCHAR)")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "events", AUDIT_SQL)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "customer", RECORDS_SQL)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "lineitem", BLOCKS_SQL)


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line) of every line of documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES_SQL = "SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
