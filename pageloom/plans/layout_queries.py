"""Queries over boxes, headings and publications. Geometry is made up from keys, so their names begin with synthetic_."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import geometry
from pageloom.operators import layout, publication
from pageloom.plans.inputs import BLOCKS_SQL, blocks, duck, table, text_lines

BLOCKS = duck(BLOCKS_SQL)
#: Boxes of line items: (doc_id, page, ord, l, t, r, b).
BOX_SQL = """
SELECT l_orderkey AS doc_id, (l_linenumber % 3 + 1)::INT AS page, l_linenumber * 1000000 + l_partkey AS ord, l_partkey, l_linenumber,
       (l_partkey % 50)::DOUBLE AS l, (l_suppkey % 70)::DOUBLE AS t, (l_partkey % 50 + 20 + l_linenumber * 5)::DOUBLE AS r, (l_suppkey % 70 + 12 + l_partkey % 9)::DOUBLE AS b
FROM lineitem"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    made = geometry.box(k % 50, s % 70, k % 50 + 20 + n * 5, s % 70 + 12 + k % 9)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (n % 3 + 1).cast("int").alias("page"), (n * 1000000 + k).alias("ord"), "l_partkey", "l_linenumber", made.alias("box"))


def synthetic_best_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd line items as items, even ones as clusters."""
    rows = _boxes(spark, sf_dir)
    items = rows.where("l_linenumber % 2 = 1").withColumn("ref", F.col("ord"))
    clusters = rows.where("l_linenumber % 2 = 0").withColumn("confidence", (F.col("l_partkey") % 100 / 100))
    found = layout.best_iou(items, clusters)
    return found.select("doc_id", "page", "ref", "confidence", F.round("iou", 6).alias("iou"))


def synthetic_combined_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.combined_bounds(_boxes(spark, sf_dir).withColumn("group_id", F.col("l_linenumber") % 2))


def synthetic_artifact_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    b = geometry.box(k % 7, k % 11, k % 7 + k % 300, k % 11 + k % 90)
    flag = geometry.is_artifact(k % 12, k % 130, geometry.rgb(k * 9973), (k % 10) / 10, (k % 5) / 10, b, F.lit(50000.0))
    outside = geometry.outside_page(b, F.lit(250.0), F.lit(80.0))
    return table(spark, sf_dir, "part").select("p_partkey", flag.alias("is_artifact"), outside.alias("outside"))


def synthetic_artifact_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that a suspicious span of the page says and covers."""
    rows = _boxes(spark, sf_dir).withColumn("text", F.concat(F.lit("t"), (F.col("l_partkey") % 4).cast("string")))
    spans = rows.where("l_linenumber > 3").withColumn("suspicious", F.col("l_partkey") % 2 == 0)
    return layout.artifact_items(rows.where("l_linenumber <= 3"), spans).select("doc_id", "page", "ord")


def synthetic_region_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).withColumn("block_id", F.col("ord"))
    halves = F.array(*[F.struct(F.lit(k).alias("region"), geometry.box(F.lit(40.0 * k), F.lit(0.0), F.lit(40.0 * k + 36), F.lit(60.0)).alias("box")) for k in range(3)])
    regions = rows.select("doc_id", "page").distinct().select("doc_id", "page", F.explode(halves).alias("h")).select("doc_id", "page", "h.*")
    return layout.region_claims(rows, regions)


def synthetic_top_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    b = geometry.box(k % 90, k % 80, k % 40, k % 60)
    turned = geometry.top_left(b, F.when(k % 2 == 0, "CoordOrigin.BOTTOMLEFT").otherwise("TOPLEFT"), F.lit(100.0))
    cut = geometry.crop(geometry.box(k % 90, k % 80, k % 90 + 5, k % 80 + 5), F.lit(100.0), F.lit(100.0), F.lit(200), F.lit(300))
    return table(spark, sf_dir, "part").select("p_partkey", turned.alias("x"), cut.alias("c")).select("p_partkey", "x.*", "c.left", "c.bottom")


def synthetic_running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 200).alias("doc_id"), F.concat(F.lit("k"), (F.col("l_partkey") % 40).cast("string")).alias("key"), (F.col("l_suppkey") % 30).alias("page"), (F.col("l_partkey") % 40 / 200 + F.col("l_linenumber") / 1000).alias("top_ratio"))
    return layout.running_headers(lines)


def synthetic_heading_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).select("doc_id", "page", F.col("box.t").alias("top"), (F.col("l_partkey") % 4 == 0).alias("is_h1"), "ord")
    return layout.scope_of(rows).select("doc_id", "ord", "scope")


def synthetic_heading_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("doc_id"), F.lit(0).alias("scope"), (F.col("l_partkey") % 12 / 2).alias("size"), (F.col("l_suppkey") % 3).alias("weight"), (F.col("l_linenumber") % 4).cast("int").alias("dots"))
    return layout.heading_tiers(rows).groupBy("doc_id", F.coalesce("level", F.lit(0)).alias("level")).agg(F.count("*").alias("headings"))


def synthetic_page_offset_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 60).alias("target"), (F.col("l_suppkey") % 40).alias("printed"))
    return layout.offset_median(rows)


def synthetic_page_offset_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord"), (F.col("l_partkey") % 3).alias("key"), F.col("l_linenumber").cast("bigint").alias("printed"))
    return layout.offset_vote(rows, rows.select("doc_id", (F.col("printed") + F.col("key")).alias("page"), "key"))


def publication_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publication.statistics(blocks(spark, sf_dir).withColumn("removed", F.col("ord") % 7 == 0))


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a heading or paragraph: (doc_id, ord, page, level, text)."""
    k = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 1000000 + k).alias("ord"), F.col("l_linenumber").alias("page"), (k % 5 + 1).cast("int").alias("level"), F.concat(F.when(k % 2 == 0, "Chapter 1. ").otherwise(""), F.lit("Topic "), (k % 3).cast("string")).alias("text"))


HEADINGS = "(SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS ord, l_linenumber AS page, (l_partkey % 5 + 1)::INT AS level, CASE WHEN l_partkey % 2 = 0 THEN 'Chapter 1. ' ELSE '' END || 'Topic ' || (l_partkey % 3) AS text FROM lineitem)"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publication.section_table(publication.sections(_headings(spark, sf_dir)))


def section_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = publication.for_readers(publication.section_table(publication.sections(_headings(spark, sf_dir))))
    return publication.neighbours(rows, "section").select("doc_id", "section", "previous", "next")


def heading_close_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publication.heading_close_up(_headings(spark, sf_dir), ["doc_id"], "ord", "level")


def validation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publication.validation(_headings(spark, sf_dir))


def slug_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publication.unique_slugs(_headings(spark, sf_dir), ["doc_id"], "ord", "text").select("doc_id", "ord", "slug")


def list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of turns of one role in conversations."""
    return publication.list_runs(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role").groupBy("conv_id", "run").agg(F.count("*").alias("turns"))


def section_order_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), (n * 4).alias("page"))
    rows = rows.agg(F.min(n * 1000000 + k).alias("ord"), F.max(F.when(k % 3 == 0, n * 2)).cast("bigint").alias("seq"))
    return publication.interpolated_order(rows).select("doc_id", "page", F.round("position", 6).alias("position"))


def recommendation_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publication.snippets(text_lines(spark, sf_dir), ["doc_id"], "line_no", "line").select("doc_id", F.col("rank").cast("bigint").alias("rank"), "snippet")


def summary_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", publication.summary(F.split("text", "\n"), 420).alias("summary"))


def json_ld_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = publication.json_ld(F.col("p_partkey"), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")), F.lit(""), F.array(F.lit("One"), F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", node.alias("json"))


QUERIES = {f.__name__: f for f in (synthetic_best_iou, synthetic_combined_bounds, synthetic_artifact_spans, synthetic_artifact_items, synthetic_region_claims, synthetic_top_left, synthetic_running_headers, synthetic_heading_scope, synthetic_heading_tiers, synthetic_page_offset_median, synthetic_page_offset_vote, publication_statistics, sections, section_neighbours, heading_close_up, validation_checks, slug_unique, list_runs, section_order_interpolation, recommendation_snippets, summary_sentences, json_ld_report)}

_X = "greatest(0, least(i.r, c.r) - greatest(i.l, c.l)) * greatest(0, least(i.b, c.b) - greatest(i.t, c.t))"
_IOU = f"{_X} / ((i.r - i.l) * (i.b - i.t) + (c.r - c.l) * (c.b - c.t) - {_X})"
_SECTIONED = f"""
WITH h AS (SELECT *, lower(regexp_replace(text, '^Chapter 1\\. ', '')) AS key FROM {HEADINGS}),
s AS (SELECT doc_id, ord, key IS DISTINCT FROM lag(key) OVER (PARTITION BY doc_id ORDER BY ord) AS starts FROM h WHERE level = 1),
n AS (SELECT h.*, coalesce(starts, false) AS starts, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY h.doc_id ORDER BY h.ord)::BIGINT AS section FROM h LEFT JOIN s ON s.doc_id = h.doc_id AND s.ord = h.ord),
t AS (SELECT doc_id, section, coalesce(min_by(text, ord) FILTER (starts), 'Front matter') AS title, min(page) AS page, count(*) AS blocks FROM n GROUP BY 1, 2)"""
ORACLES = {
    "synthetic_best_iou": f"""
WITH x AS ({BOX_SQL}),
m AS (SELECT i.doc_id, i.ord AS ref, {_IOU} AS iou, c.ord, c.l_partkey % 100 / 100 AS confidence
      FROM x i JOIN x c ON c.doc_id = i.doc_id AND c.page = i.page AND i.l_linenumber % 2 = 1 AND c.l_linenumber % 2 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ref ORDER BY iou DESC, ord) AS k FROM m WHERE iou > 0.3)
SELECT x.doc_id, x.page, x.ord AS ref, f.confidence::DOUBLE AS confidence, round(f.iou, 6) AS iou FROM x LEFT JOIN f ON f.doc_id = x.doc_id AND f.ref = x.ord AND k = 1 WHERE l_linenumber % 2 = 1""",
    "synthetic_combined_bounds": f"WITH x AS ({BOX_SQL}), f AS (SELECT doc_id, l_linenumber % 2 AS group_id, min_by(page, ord) AS page FROM x GROUP BY 1, 2) SELECT x.doc_id, f.group_id, x.page, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b FROM x JOIN f ON f.doc_id = x.doc_id AND f.group_id = x.l_linenumber % 2 AND f.page = x.page GROUP BY 1, 2, 3",
    "synthetic_artifact_spans": """
WITH p AS (SELECT p_partkey, p_partkey AS k, (p_partkey % 300)::DOUBLE * (p_partkey % 90) / 50000 AS share, ((p_partkey * 9973) >> 16 & 255) + ((p_partkey * 9973) >> 8 & 255) + ((p_partkey * 9973) & 255) AS c FROM part)
SELECT p_partkey, (k % 10) / 10 < 0.58 OR (k % 5) / 10 > 0.17 AND k % 130 >= 20 AND k % 12 <= 8 OR k % 130 >= 110 AND k % 12 <= 10 OR share >= 0.075 AND k % 12 <= 8
       OR c / 765 >= 0.86 AND k % 130 >= 34 AND k % 12 <= 8 OR k % 7 < 2 AND k % 130 >= 22 AND k % 12 <= 2 AS is_artifact,
       k % 7 + k % 300 > 253 OR k % 11 + k % 90 > 83 AS outside FROM p""",
    "synthetic_artifact_items": f"WITH x AS (SELECT *, l_partkey % 4 AS w FROM ({BOX_SQL})) SELECT i.doc_id, i.page, i.ord FROM x i WHERE i.l_linenumber <= 3 AND EXISTS (SELECT 1 FROM x c WHERE c.l_linenumber > 3 AND c.l_partkey % 2 = 0 AND c.doc_id = i.doc_id AND c.page = i.page AND c.w = i.w AND {_X} / ((i.r - i.l) * (i.b - i.t)) >= 0.45)",
    "synthetic_region_claims": f"SELECT doc_id, ord AS block_id, min(k)::INT AS region FROM ({BOX_SQL}) x, (SELECT unnest([0, 1, 2]) AS k) WHERE (l + r) / 2 BETWEEN 40 * k - 3 AND 40 * k + 39 AND (t + b) / 2 BETWEEN -3 AND 63 GROUP BY 1, 2",
    "synthetic_top_left": """
SELECT p_partkey, least(k % 90, k % 40)::DOUBLE AS l, least(t, b)::DOUBLE AS t, greatest(k % 90, k % 40)::DOUBLE AS r, greatest(t, b)::DOUBLE AS b,
       greatest(0, (k % 90) * 2 - 20)::INT AS "left", least(300, (k % 80 + 5) * 3 + 20)::INT AS bottom
FROM (SELECT p_partkey, p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 100 - p_partkey % 80 ELSE p_partkey % 80 END AS t, CASE WHEN p_partkey % 2 = 0 THEN 100 - p_partkey % 60 ELSE p_partkey % 60 END AS b FROM part)""",
    "synthetic_running_headers": "SELECT doc_id, key, pages FROM (SELECT l_orderkey % 200 AS doc_id, 'k' || (l_partkey % 40) AS key, count(DISTINCT l_suppkey % 30) AS pages, max(l_suppkey % 30) - min(l_suppkey % 30) + 1 AS span, max(l_partkey % 40 / 200 + l_linenumber / 1000) - min(l_partkey % 40 / 200 + l_linenumber / 1000) AS spread FROM lineitem WHERE l_partkey % 40 / 200 + l_linenumber / 1000 <= 0.18 GROUP BY 1, 2) WHERE pages >= 3 AND span <= 3 * pages AND spread <= 0.025",
    "synthetic_heading_scope": f"SELECT doc_id, ord, (CASE WHEN bool_or(l_partkey % 4 = 0) OVER (PARTITION BY doc_id) THEN sum((l_partkey % 4 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY page, t, (l_partkey % 4 = 0) DESC, ord) - 1 ELSE 0 END)::BIGINT AS scope FROM ({BOX_SQL})",
    "synthetic_heading_tiers": """
SELECT doc_id, CASE WHEN dots > 0 THEN greatest(style, least(5, dots + 2)) ELSE coalesce(style, 0) END AS level, count(*) AS headings
FROM (SELECT l_orderkey % 500 AS doc_id, (l_linenumber % 4)::INT AS dots, CASE WHEN r <= 3 THEN (r + 2)::INT END AS style
      FROM (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey % 500 ORDER BY l_partkey % 12 / 2 DESC, l_suppkey % 3 DESC) AS r FROM lineitem)) GROUP BY 1, 2""",
    "synthetic_page_offset_median": "SELECT l_orderkey AS doc_id, round_even(median(l_partkey % 60 - l_suppkey % 40), 0)::BIGINT AS page_offset FROM lineitem GROUP BY 1",
    "synthetic_page_offset_vote": """
WITH e AS (SELECT l_orderkey AS doc_id, l_partkey % 3 AS key, l_linenumber::BIGINT AS printed, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 1000000 + l_partkey) AS n FROM lineitem),
p AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber + l_partkey % 3 AS page, l_partkey % 3 AS key FROM lineitem),
v AS (SELECT e.doc_id, page - printed AS page_offset, count(DISTINCT n) AS hits FROM e JOIN p ON p.doc_id = e.doc_id AND p.key = e.key WHERE n <= 16 AND page - printed BETWEEN -10 AND 80 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, page_offset) AS k FROM v)
SELECT doc_id, page_offset, hits FROM r WHERE k = 1 AND (hits >= 2 OR (SELECT count(*) FROM e WHERE e.doc_id = r.doc_id) = 1)""",
    "publication_statistics": f"SELECT doc_id, count(DISTINCT page) AS pages, count(*) FILTER (label IN ('section_header_1', 'section_header_2', 'text', 'list')) AS text_items, count(*) FILTER (label IN ('table', 'document_index')) AS tables, count(*) FILTER (label = 'picture') AS pictures, 0::BIGINT AS footnotes FROM ({BLOCKS}) WHERE ord % 7 <> 0 GROUP BY 1",
    "sections": f"{_SECTIONED} SELECT * FROM t",
    "section_neighbours": f"{_SECTIONED} SELECT doc_id, section, lag(title) OVER w AS previous, lead(title) OVER w AS next FROM t WHERE title <> 'Front matter' WINDOW w AS (PARTITION BY doc_id ORDER BY section)",
    "heading_close_up": f"""
WITH RECURSIVE h AS (SELECT doc_id, ord, level, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM {HEADINGS}),
c AS (SELECT doc_id, ord, k, least(greatest(2, least(5, level)), 2) AS level FROM h WHERE k = 1
      UNION ALL SELECT h.doc_id, h.ord, h.k, least(greatest(2, least(5, h.level)), c.level + 1) FROM c JOIN h ON h.doc_id = c.doc_id AND h.k = c.k + 1)
SELECT doc_id, ord, level FROM c""",
    "validation_checks": f"SELECT doc_id, count(*) FILTER (skips) AS skipped_levels, count(*) AS headings FROM (SELECT doc_id, level > coalesce(lag(level) OVER (PARTITION BY doc_id ORDER BY ord), level) + 1 AS skips FROM {HEADINGS}) GROUP BY 1",
    "slug_unique": f"SELECT doc_id, ord, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY ord) AS n FROM (SELECT doc_id, ord, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM {HEADINGS}))",
    "list_runs": "SELECT conv_id, run, count(*) AS turns FROM (SELECT conv_id, sum(breaks) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM (SELECT conv_id, turn, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS breaks FROM conversations)) GROUP BY 1, 2",
    "section_order_interpolation": """
WITH x AS (SELECT l_orderkey AS doc_id, l_linenumber * 4 AS page, min(l_linenumber * 1000000 + l_partkey) AS ord, max(CASE WHEN l_partkey % 3 = 0 THEN l_linenumber * 2 END) AS seq FROM lineitem GROUP BY 1, 2),
y AS (SELECT *, max_by(page, page) FILTER (seq IS NOT NULL) OVER w AS bp, max_by(seq, page) FILTER (seq IS NOT NULL) OVER w AS bs,
             min_by(page, page) FILTER (seq IS NOT NULL) OVER v AS ap, min_by(seq, page) FILTER (seq IS NOT NULL) OVER v AS s2
      FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY doc_id ORDER BY page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT doc_id, page, round(CASE WHEN seq IS NOT NULL THEN seq WHEN bs IS NULL AND s2 IS NULL THEN ord WHEN bs IS NULL THEN s2 - 1 - (ap - page) / 100000::DOUBLE
       WHEN s2 IS NULL THEN bs + 1 + (page - bp) / 100000::DOUBLE WHEN s2 > bs THEN bs + (page - bp) / greatest(1, ap - bp)::DOUBLE * (s2 - bs) ELSE bs + 0.5 + (page - bp) / greatest(1, ap - bp)::DOUBLE / 100 END::DOUBLE, 6) AS position FROM y""",
    "recommendation_snippets": """
WITH l AS (SELECT doc_id, unnest(range(len(a))) AS n, trim(regexp_replace(unnest(a), '\\s+', ' ', 'g')) AS snippet FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
f AS (SELECT doc_id, snippet, min(n) AS first_at FROM l WHERE length(snippet) >= 24 GROUP BY 1, 2),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_at, snippet) AS rank, snippet FROM f)
SELECT doc_id, rank, snippet FROM r WHERE rank <= 3""",
    "json_ld_report": """SELECT p_partkey, '{"@context":"https://schema.org","@type":"Report","@id":"#' || p_partkey || '","name":"' || p_name || '"' || CASE WHEN p_partkey % 2 = 0 THEN ',"publisher":{"@type":"Organization","name":"' || p_brand || '"}' ELSE '' END || ',"hasPart":[{"@type":"Chapter","name":"One","position":1},{"@type":"Chapter","name":"' || p_type || '","position":2}]}' AS json FROM part""",
}
