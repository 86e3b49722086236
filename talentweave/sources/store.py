"""Results kept by key between runs: what was computed once comes back, what is new is added once.

A run adds one folder of Parquet files, divided by bucket of the key and sorted by it. Spark's ``_SUCCESS`` marker makes a
folder part of the store, so a broken run leaves nothing that is read, and the next one takes its place. Keys
that a later run replaces are listed beside it; only then does reading join that list. A store has one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.plans.storage import drop_tables, exists, list_names, materialize

BUCKETS = 64


class ResultStore:
    """Results under ``path`` by the text column ``key``. NULL keys are not stored; all runs have the columns of the first."""

    def __init__(self, spark: SparkSession, path: str, key: str = "document_hash", buckets: int = BUCKETS):
        if buckets < 1:
            raise ValueError("a store needs at least one bucket")
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def runs(self) -> list[int]:
        """Numbers of the runs that ended well."""
        found = [int(n[4:]) for n in list_names(self.spark, self.path) if n.startswith("run=") and n[4:].isdigit()]
        return sorted(n for n in found if exists(self.spark, f"{self._folder(n)}/_SUCCESS"))

    def _folder(self, run: int, kind: str = "run") -> str:
        return f"{self.path}/{kind}={run}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, kind: str, runs: list[int]) -> DataFrame | None:
        folders = [f for n in runs if exists(self.spark, f"{(f := self._folder(n, kind))}/_SUCCESS")]
        if not folders:
            return None
        return self.spark.read.option("basePath", self.path).parquet(*folders).withColumnRenamed(kind, "_run")

    def _current(self) -> DataFrame | None:
        runs = self.runs()
        rows, gone = self._rows("run", runs), self._rows("replaced", runs)
        if rows is None or gone is None:
            return rows
        last = gone.groupBy("bucket", self.key).agg(F.max("_run").alias("_last"))
        joined = rows.join(last, ["bucket", self.key], "left")
        return joined.where(F.col("_last").isNull() | (F.col("_run") >= F.col("_last"))).drop("_last")

    def read(self) -> DataFrame | None:
        """All results, one row per key; None while there is no run."""
        rows = self._current()
        return None if rows is None else rows.drop("_run", "bucket")

    def find(self, keys: DataFrame) -> DataFrame | None:
        """The results of those keys that have one. Only buckets that the keys fall into are read."""
        rows = self._current()
        if rows is None:
            return None
        wanted = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct().withColumn("bucket", self._bucket())
        buckets = [r[0] for r in wanted.select("bucket").distinct().collect()]  # at most the number of buckets
        return rows.where(F.col("bucket").isin(buckets)).join(wanted, ["bucket", self.key], "left_semi").drop("_run", "bucket")

    def save(self, rows: DataFrame, replace: bool = False) -> int:
        """Add the rows with new keys, with ``replace`` those with known keys too; returns how many were stored.

        ``rows`` has one row per key; of several the store would keep all, so they are refused.
        """
        runs = self.runs()
        placed = rows.where(F.col(self.key).isNotNull()).withColumn("bucket", self._bucket())
        if runs:
            known = self._rows("run", runs)
            if T.StructType(sorted(rows.schema, key=lambda f: f.name)).simpleString() != T.StructType(
                    sorted(known.drop("_run", "bucket").schema, key=lambda f: f.name)).simpleString():
                raise ValueError(f"the store has the columns {known.drop('_run', 'bucket').schema.simpleString()}")
            if not replace:
                placed = placed.join(known.select("bucket", self.key), ["bucket", self.key], "left_anti")
        placed = materialize(placed, "to-store")  # what it is computed from runs once
        found = placed.agg(F.count("*").alias("n"), F.count_distinct(self.key).alias("keys")).first()
        if found.n != found.keys:
            raise ValueError(f"{found.n - found.keys} rows repeat a key")
        if not found.n:
            return 0
        run = (runs[-1] if runs else 0) + 1
        drop_tables(self.spark, [self._folder(run, "replaced"), self._folder(run)])  # what a broken run left
        if replace and runs:
            old = placed.select("bucket", self.key).join(known.select("bucket", self.key).distinct(), ["bucket", self.key], "left_semi")
            self._write(old, self._folder(run, "replaced"))
        self._write(placed, self._folder(run))
        return found.n

    def _write(self, rows: DataFrame, folder: str) -> None:
        in_order = rows.repartition("bucket").sortWithinPartitions("bucket", self.key)
        in_order.write.mode("overwrite").partitionBy("bucket").parquet(folder)
