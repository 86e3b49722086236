"""Column expressions and table helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One word, and one run of what separates words, as regular expressions for Java and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def word_count(text: str) -> Column:
    """Number of words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def running_total(rows: DataFrame, key: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all earlier rows of the same ``key``.

    ``bucket`` is a number that grows with ``order``. Totals of buckets are summed first, so that a key
    that holds most rows is spread over as many tasks as it has buckets. NULL is a key like any other.
    """
    totals = rows.groupBy(key, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        F.col(key).alias("_of_key"), F.col(bucket).alias("_of_bucket"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = local.join(base, F.col(key).eqNullSafe(F.col("_of_key")) & (F.col(bucket) == F.col("_of_bucket")))
    return joined.withColumn(out, F.col("_base") + F.col("_local")).drop("_of_key", "_of_bucket", "_base", "_local")


def boxed(docs: DataFrame, *roles: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns named c0, c1, ... so that an operator's own columns can't clash; and the new names of ``roles``."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [names[r] for r in roles]


def unboxed(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Undo ``boxed``: just the columns of ``docs``, under their names."""
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
