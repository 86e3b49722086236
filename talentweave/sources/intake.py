"""Documents by content hash, and extracted résumé JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.functions import strict
from talentweave.functions import text as X
from talentweave.schemas import RESUME


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files as ``(path, content, document_hash)``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return with_hash(files.select("path", "content"), "content")


def with_hash(rows: DataFrame, column: str, out: str = "document_hash") -> DataFrame:
    """SHA-256 in hexadecimal over the bytes of a binary column or the UTF-8 bytes of a text column."""
    return rows.withColumn(out, F.sha2(F.col(column).cast("binary"), 256))


def distinct_documents(documents: DataFrame, order: str) -> DataFrame:
    """One document per hash, the one that comes first by ``order``.

    Copies shrink to one small row per hash before the exchange; content is fetched by key afterwards.
    """
    first = documents.groupBy("document_hash").agg(F.min(order).alias(order))
    return documents.join(first, ["document_hash", order], "left_semi")


def new_documents(documents: DataFrame, processed: DataFrame, order: str, force_refresh: bool = False) -> DataFrame:
    """Distinct documents that still need processing."""
    once = distinct_documents(documents, order)
    return once if force_refresh else once.join(processed.select("document_hash"), "document_hash", "left_anti")


def from_cache(documents: DataFrame, processed: DataFrame, order: str, force_refresh: bool = False) -> DataFrame:
    """Every distinct document with ``from_cache``: whether an earlier result serves it."""
    known = processed.select("document_hash").distinct().withColumn("_known", F.lit(True))
    return (
        distinct_documents(documents, order).join(known, "document_hash", "left")
        .withColumn("from_cache", F.col("_known").isNotNull() & F.lit(not force_refresh)).drop("_known")
    )


def ingest_json(rows: DataFrame, column: str, schema: T.StructType = RESUME, required: list[str] | None = None) -> DataFrame:
    """Parse extracted JSON: ``ingest_status`` is ok, empty_output, invalid_json or invalid_schema.

    Types are checked without conversion at every depth, with what the schema's metadata asks for; unknown fields
    are ignored. ``required`` names further columns below ``record`` that must be present. The parsed value is
    ``record``, and ``schema_errors`` lists the errors (path, message, value) of records that break the schema.
    """
    staged = rows.withColumn("_json", strip_and_null(F.col(column))).withColumn(
        "_errors", strict.json_errors(F.col("_json"), schema)
    ).withColumn("_record", F.from_json(F.when(F.size("_errors") == 0, F.col("_json")), schema))
    missing = F.lit(False)
    for name in required or []:
        missing = missing | F.col(f"_record.{name}").isNull()
    status = (
        F.when(F.col("_json").isNull(), "empty_output")
        .when(~X.is_json(F.col("_json")), "invalid_json")
        .when((F.size("_errors") > 0) | F.col("_record").isNull() | missing, "invalid_schema")
        .otherwise("ok")
    )
    return (
        staged.withColumn("ingest_status", status)
        .withColumn("record", F.when(F.col("ingest_status") == "ok", F.col("_record")))
        .withColumn("schema_errors", F.when(F.col("ingest_status") == "invalid_schema", F.col("_errors")).otherwise(strict.none()))
        .drop("_json", "_record", "_errors")
    )


def strip_and_null(c):
    """Text without its Markdown fence; NULL when nothing is left."""
    return F.nullif(X.strip_fence(c), F.lit(""))
