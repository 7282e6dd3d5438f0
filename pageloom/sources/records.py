"""Document records and artifacts as files: scans that skip what is unreadable, upserts, deletes, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("id", "title", "file_name", "publisher", "uploaded_by", "uploaded_by_email", "approved_at")],
        T.StructField("pages", T.IntegerType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("created_at", T.DoubleType()),
        T.StructField("updated_at", T.DoubleType()),
        T.StructField("metadata_confirmed", T.BooleanType()),
        T.StructField("job", T.StructType([T.StructField("state", T.StringType()), T.StructField("current_step", T.IntegerType()), T.StructField("message", T.StringType())])),
    ]
)
MAX_FILES, MAX_BYTES, MAGIC, MAGIC_WITHIN = 5, 200 * 1024 * 1024, b"%PDF-", 1024


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All readable records under path, oldest first; files that are no JSON are skipped."""
    rows = spark.read.schema(RECORD).option("mode", "DROPMALFORMED").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "record.json").json(path)
    return rows.where("id is not null").orderBy("created_at", "id")


def read_layout(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Extracted layout documents (one JSON a file) by a given schema."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_table(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.format(kind).load(path)


def upserted(records: DataFrame, changes: DataFrame, key: str = "id", stamp: Column | None = None, order: str = "ord") -> DataFrame:
    """records with changes laid over them, and new keys added; a null in a change leaves the field as it is.

    Several changes of one key are merged first, in the order of a column of changes, or of their values if there is no such column: each field has the last value given.
    """
    changed = [c for c in changes.columns if c not in (key, order)]
    step = F.col(order) if order in changes.columns else F.struct(*changed)
    changes = changes.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), step)).alias(c) for c in changed])
    met = records.join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in changed], F.lit(True).alias("_hit")), key, "full")
    out = met.select(key, *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in changed else F.col(c) for c in records.columns if c != key], "_hit")
    if stamp is not None and "updated_at" in out.columns:
        out = out.withColumn("updated_at", F.when(F.col("_hit"), stamp).otherwise(F.col("updated_at")))
    return out.drop("_hit").select(*records.columns)


def created(records: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New records that don't take an id that is in use."""
    return new.join(records.select(key), key, "left_anti")


def deleted(records: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return records.join(ids.select(key), key, "left_anti")


#: Artifacts that stay whatever else goes, and those that are made on approval.
KEPT = "source.pdf"
GENERATED = ("publication.json", "schema.jsonld", "structured.json", "accessible.html")


def artifacts_deleted(artifacts: DataFrame, ids: DataFrame, patterns: tuple[str, ...] = GENERATED) -> DataFrame:
    """artifacts(document_id, name, value) without those of ids(document_id) whose names fit a pattern, in which * stands for any characters.

    The source is never deleted, and patterns with path separators are refused.
    """
    if any("/" in p or "\\" in p for p in patterns):
        raise ValueError("artifact patterns are names, not paths")
    fits = F.lit(False)
    for p in patterns:
        fits = fits | F.col("name").like(p.replace("%", r"\%").replace("_", r"\_").replace("*", "%"))
    gone = artifacts.where(fits & (F.col("name") != KEPT)).join(ids.select("document_id").distinct(), "document_id", "left_semi").select("document_id", "name")
    return artifacts.join(gone, ["document_id", "name"], "left_anti")


def finished(records: DataFrame, outputs: DataFrame, steps: int = 8) -> DataFrame:
    """records(id, title, publisher, job_state, job_step, job_message, job_ms) once their processing has ended: outputs(id, title, publisher, seconds).

    Titles and publishers that were found replace those of the record; documents without output stay as they are.
    """
    own = outputs.select("id", F.nullif("title", F.lit("")).alias("_title"), F.nullif("publisher", F.lit("")).alias("_publisher"), F.greatest(F.lit(1), F.bround(F.col("seconds") * 1000, 0)).cast("bigint").alias("_ms"), F.lit(True).alias("_hit"))
    met, hit = records.join(own, "id", "left"), F.col("_hit").isNotNull()
    set_to = lambda value, column: F.when(hit, value).otherwise(F.col(column))
    return met.withColumns({
        "title": F.coalesce("_title", "title"), "publisher": F.coalesce("_publisher", "publisher"), "job_ms": set_to(F.col("_ms"), "job_ms"),
        "job_state": set_to(F.lit("complete"), "job_state"), "job_step": set_to(F.lit(steps), "job_step"), "job_message": set_to(F.lit("Ready for review"), "job_message"),
    }).select(*records.columns)


def with_artifact(records: DataFrame, artifacts: DataFrame, name: str, default: str = "[]") -> DataFrame:
    """records with the JSON artifact of a name(document_id, name, value), or the default."""
    own = artifacts.where(F.col("name") == name).select(F.col("document_id").alias("id"), F.col("value").alias(name))
    return records.join(own, "id", "left").withColumn(name, F.coalesce(name, F.lit(default)))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files with the reason against each, or null. Page counts need a PDF library and are no part of this."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path)
    begins = F.instr(F.decode(F.substring("content", 1, MAGIC_WITHIN), "ISO-8859-1"), F.lit(MAGIC.decode()))
    reason = F.when(~F.lower("path").endswith(".pdf"), "415 not a pdf name").when(F.col("length") > MAX_BYTES, "413 too large").when(begins == 0, "415 not a pdf")
    return files.select("path", "length", "modificationTime", reason.alias("reason"))


def exportable(records: DataFrame) -> DataFrame:
    return records.where(F.col("approved_at").isNotNull())


def pretty_json(value: Column) -> Column:
    return F.concat(F.to_json(value, {"pretty": "true"}), F.lit("\n"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_text(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)


def size_label(size: Column) -> Column:
    """Megabytes to one place, half to even."""
    return F.format_string("%.1f MB", F.bround(size / (1024 * 1024), 1))
