"""Queries over the audit feed, document scope and job telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators import audit, scope, telemetry
from pageloom.plans.inputs import AUDIT_SQL, RECORDS_SQL, audit_log, duck, records, table

LOG, RECORDS = duck(AUDIT_SQL), duck(RECORDS_SQL)
LABELS = " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in audit.ACTIONS.items())
TONES = " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in audit.ACTIONS.items())
CHAIN = f"""
SELECT *, CASE WHEN entry_hash IS NULL OR prev_hash IS NULL THEN 'unverifiable'
               WHEN before_id IS NULL THEN CASE WHEN prev_hash = '{audit.GENESIS}' THEN 'linked' ELSE 'unverifiable' END
               WHEN before_hash IS NULL THEN 'unverifiable'
               WHEN prev_hash = before_hash THEN 'linked' ELSE 'broken' END AS chain_status
FROM (SELECT *, lag(id) OVER (ORDER BY id) AS before_id, lag(entry_hash) OVER (ORDER BY id) AS before_hash FROM ({LOG}))"""
SUMMARY = """CASE action WHEN 'upload' THEN json_extract_string(detail, '$.file_name') WHEN 'edit_review_item' THEN json_extract_string(detail, '$.item')
  WHEN 'edit_metadata' THEN 'Title: ' || json_extract_string(detail, '$.title')
  WHEN 'process_failed' THEN json_extract_string(detail, '$.file_name') || ' — ' || json_extract_string(detail, '$.error') ELSE '—' END"""


def audit_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.recent(audit_log(spark, sf_dir))
    return rows.select("id", "actor_email", audit.action_label(F.col("action")).alias("label"), audit.action_tone(F.col("action")).alias("tone"), audit.entry_summary(F.col("action"), F.col("detail")).alias("summary"))


def audit_recent_for_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.recent(audit_log(spark, sf_dir), actor="7").select("id", "action", "created_at")


def audit_chain_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.chain_status(audit_log(spark, sf_dir)).select("id", "chain_status")


def audit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = records(spark, sf_dir).select("id", "title")
    found = audit.search(audit_log(spark, sf_dir), docs, text=" EDITED ", status="broken")
    return found.select("id", "actor_email", "action", "document_title", "chain_status")


def audit_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.overview(records(spark, sf_dir), audit_log(spark, sf_dir))


def audit_actor_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_log(spark, sf_dir).where(F.coalesce("actor_email", F.lit("")) != "").select("actor_email").distinct()


def audit_history_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.uploads(audit_log(spark, sf_dir))


def audit_join_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = records(spark, sf_dir).select(F.col("id").alias("document_id"), "title", "file_name")
    return audit_log(spark, sf_dir).join(docs, "document_id", "left").select("id", "document_id", "title", "file_name")


def audit_change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of orders before and after a change of some of the fields."""
    orders = table(spark, sf_dir, "orders")
    before = F.create_map(F.lit("title"), F.col("o_orderpriority"), F.lit("publisher"), F.col("o_orderstatus"))
    after = F.create_map(F.lit("title"), F.lower("o_orderpriority"), F.lit("citations"), F.col("o_custkey").cast("string"))
    return audit.change_rows(orders.select(F.col("o_orderkey").alias("id"), before.alias("before"), after.alias("after")))


def audit_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", audit.snippet(F.col("text")).alias("s")).select("doc_id", "s.preview", "s.truncated", F.col("s.length").cast("bigint").alias("length"))


def audit_counts_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_log(spark, sf_dir).groupBy("action", audit.action_tone(F.col("action")).alias("tone")).agg(F.count("*").alias("events"), F.count_distinct("actor_id").alias("actors"))


def scope_own_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scope.own_documents(records(spark, sf_dir), "user7")
    return rows.select("id", "uploaded_by", scope.may_change(F.col("uploaded_by"), "user7", False).alias("may_change"), scope.valid_id(F.col("id")).alias("valid_id"))


def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.find_documents(records(spark, sf_dir), text="Machinery-1", state="idle").select("id", "title", "file_name")


def workflow_unlock(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = scope.unlocked(F.col("state"), F.col("metadata_confirmed"), F.col("approved_at").isNotNull())
    return records(spark, sf_dir).select("id", *[c.alias(k) for k, c in flags.items()])


def approval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = scope.approval_gate(F.col("record_key") % 2, F.col("metadata_confirmed"), F.col("title"), F.col("publisher"))
    return records(spark, sf_dir).select("id", gate.alias("reason"))


def error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages made up of the page of an order and two pieces, of which the kind that stands first in the rules counts; some orders have none."""
    piece = lambda k: F.element_at(F.array(*[F.lit(w) for w in MESSAGES]), (k % len(MESSAGES) + 1).cast("int"))
    message = F.when(F.col("o_custkey") % 17 > 0, F.concat(F.lit("Page "), F.col("o_custkey").cast("string"), F.lit(": "), piece(F.col("o_orderkey")), F.lit(" / "), piece(F.col("o_custkey"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", scope.error_class(message).alias("kind"))


MESSAGES = ("Out of memory", "File is ENCRYPTED", "broken xref table", "socket closed", "Not a PDF", "no idea", "network password", "truncated; timed out")


def eta_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = (F.col("o_custkey") % 900).cast("bigint")
    eta = telemetry.estimate_seconds(pages, F.lit(2.75), F.lit(30.0), F.col("o_orderkey") % 2 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", eta.alias("seconds"), telemetry.remaining_text(eta).alias("shown"))


def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("l_quantity") * 2
    low = (F.col("l_linenumber") * 10).cast("double")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", telemetry.stage_progress(at, low, low + 20.0).alias("progress"), telemetry.remaining_seconds(F.lit(90.5), at).alias("remaining"))


def ewma_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running average over each customer's orders in key order."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 50).alias("pages"), (F.col("o_totalprice") * 0.00777777).alias("seconds"))
    return telemetry.running_rates(orders, "o_custkey", "o_orderkey", baseline_startup=31.4159)


QUERIES = {f.__name__: f for f in (audit_recent, audit_recent_for_actor, audit_chain_status, audit_search, audit_overview, audit_actor_options, audit_history_uploads, audit_join_documents, audit_change_rows, audit_snippets, audit_counts_by_action, scope_own_documents, document_search, workflow_unlock, approval_gate, error_class, eta_estimate, stage_progress, ewma_rate)}
_DONE = "coalesce(state = 'complete', false)"
_ETA = "greatest(10, round_even(30.0::DOUBLE + greatest(1, o_custkey % 900) * 2.75::DOUBLE * CASE WHEN o_orderkey % 2 = 0 THEN 1.85::DOUBLE ELSE 1.0::DOUBLE END, 0))::BIGINT"
ORACLES = {
    "audit_recent": f"SELECT id, actor_email, CASE action {LABELS} ELSE action END AS label, CASE action {TONES} ELSE 'neutral' END AS tone, {SUMMARY} AS summary FROM ({LOG}) ORDER BY id DESC LIMIT 100",
    "audit_recent_for_actor": f"SELECT id, action, created_at FROM ({LOG}) WHERE actor_id = '7' ORDER BY id DESC LIMIT 100",
    "audit_chain_status": f"SELECT id, chain_status FROM ({CHAIN})",
    "audit_search": f"SELECT c.id, actor_email, action, r.title AS document_title, chain_status FROM ({CHAIN}) c LEFT JOIN ({RECORDS}) r ON r.id = c.document_id WHERE chain_status = 'broken' AND contains(lower(actor_email || ' ' || coalesce(r.title, document_id) || ' ' || CASE action {LABELS} ELSE action END), 'edited')",
    "audit_overview": f"SELECT * FROM (SELECT count(*) AS documents, count(*) FILTER (state = 'complete' AND approved_at IS NULL) AS awaiting_approval, count(*) FILTER (state = 'failed') AS failures, count(DISTINCT nullif(uploaded_by, '')) AS contributors FROM ({RECORDS})), (SELECT count(*) FILTER (chain_status = 'broken') AS broken_links, count(*) AS events FROM ({CHAIN}))",
    "audit_actor_options": f"SELECT DISTINCT actor_email FROM ({LOG}) WHERE coalesce(actor_email, '') <> ''",
    "audit_history_uploads": f"SELECT document_id, coalesce(json_extract_string(detail, '$.file_name'), 'Unknown file') AS file_name, json_extract_string(detail, '$.pages')::BIGINT AS pages, created_at AS uploaded_at FROM ({LOG}) WHERE action = 'upload'",
    "audit_join_documents": f"SELECT l.id, l.document_id, r.title, r.file_name FROM ({LOG}) l LEFT JOIN ({RECORDS}) r ON r.id = l.document_id",
    "audit_change_rows": "SELECT o_orderkey AS id, 'title' AS field, o_orderpriority AS before_value, lower(o_orderpriority) AS after_value FROM orders UNION ALL SELECT o_orderkey, 'citations', NULL, o_custkey::VARCHAR FROM orders",
    "audit_snippets": "SELECT doc_id, left(text, 200) AS preview, length(text) > 200 AS truncated, length(text)::BIGINT AS length FROM documents",
    "audit_counts_by_action": f"SELECT action, CASE action {TONES} ELSE 'neutral' END AS tone, count(*) AS events, count(DISTINCT actor_id) AS actors FROM ({LOG}) GROUP BY 1, 2",
    "scope_own_documents": f"SELECT id, uploaded_by, coalesce(uploaded_by = '', true) OR uploaded_by = 'user7' AS may_change, true AS valid_id FROM ({RECORDS}) WHERE uploaded_by IS NULL OR uploaded_by = 'user7'",
    "document_search": f"SELECT id, title, file_name FROM ({RECORDS}) WHERE coalesce(state, 'idle') = 'idle' AND contains(lower(title || ' ' || file_name || ' ' || coalesce(uploaded_by, '')), 'machinery-1')",
    "workflow_unlock": f"SELECT id, {_DONE} AS review_open, {_DONE} AS metadata_open, {_DONE} AS approval_open, {_DONE} AND (metadata_confirmed OR approved_at IS NOT NULL) AS preview_open FROM ({RECORDS})",
    "approval_gate": f"SELECT id, CASE WHEN record_key % 2 > 0 THEN 'open_review_items' WHEN NOT metadata_confirmed THEN 'metadata_not_confirmed' WHEN trim(title) = '' OR trim(publisher) = '' THEN 'title_or_publisher_missing' END AS reason FROM ({RECORDS})",
    "error_class": f"""
WITH w AS (SELECT {list(MESSAGES)!r} AS w),
m AS (SELECT o_orderkey, CASE WHEN o_custkey % 17 > 0 THEN lower('Page ' || o_custkey || ': ' || w[o_orderkey % 8 + 1] || ' / ' || w[o_custkey % 8 + 1]) END AS m FROM orders, w)
SELECT o_orderkey, CASE WHEN m LIKE '%out of memory%' THEN 'memory' WHEN m LIKE '%password%' OR m LIKE '%encrypted%' THEN 'password' WHEN m LIKE '%xref%' OR m LIKE '%truncated%' THEN 'damaged'
       WHEN m LIKE '%socket%' OR m LIKE '%network%' OR m LIKE '%timed out%' THEN 'network' WHEN m LIKE '%not a pdf%' THEN 'unsupported' ELSE 'other' END AS kind FROM m""",
    "eta_estimate": f"SELECT o_orderkey, s AS seconds, CASE WHEN s >= 3600 THEN (s // 3600) || ' hr ' || (s % 3600 // 60) || ' min ' || (s % 60) || ' sec' WHEN s >= 60 THEN (s // 60) || ' min ' || (s % 60) || ' sec' ELSE s || ' sec' END AS shown FROM (SELECT o_orderkey, {_ETA} AS s FROM orders)",
    "stage_progress": "SELECT l_orderkey, l_linenumber, greatest(l_linenumber * 10, least(l_quantity * 2, l_linenumber * 10 + 20))::DOUBLE AS progress, greatest(1, ceil(90.5 - l_quantity * 2))::BIGINT AS remaining FROM lineitem",
    "ewma_rate": """
WITH RECURSIVE runs AS (
  SELECT o_custkey, o_orderkey % 50 AS pages, o_totalprice * 0.00777777::DOUBLE AS seconds, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k
  FROM orders WHERE o_orderkey % 50 > 0 AND o_totalprice > 0),
samples AS (SELECT o_custkey, k, least(31.4159::DOUBLE, seconds * 0.4::DOUBLE) AS startup, greatest(0.1::DOUBLE, (seconds - least(31.4159::DOUBLE, seconds * 0.4::DOUBLE)) / pages) AS rate FROM runs),
steps AS (
  SELECT o_custkey, k, round_even(rate, 4) AS rate, round_even(startup, 2) AS startup FROM samples WHERE k = 1
  UNION ALL
  SELECT s.o_custkey, s.k, round_even(t.rate * 0.7::DOUBLE + s.rate * 0.3::DOUBLE, 4), round_even(t.startup * 0.7::DOUBLE + s.startup * 0.3::DOUBLE, 2)
  FROM steps t JOIN samples s ON s.o_custkey = t.o_custkey AND s.k = t.k + 1)
SELECT o_custkey, max_by(rate, k) AS seconds_per_page, max_by(startup, k) AS startup_seconds, max(k)::BIGINT AS samples FROM steps GROUP BY o_custkey""",
}
