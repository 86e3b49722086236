"""Results kept between runs, and results filed by date."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.plans.pipelines import process_documents
from talentweave.sources import intake
from talentweave.sources.store import ResultStore
from talentweave.sources.tables import write_results

RECORD = T.StructType([T.StructField("size", T.IntegerType())])


def documents(spark, texts):
    return intake.with_hash(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), "text")


class Extractor:
    """Counts its calls; texts with an x give no record while ``broken``."""

    def __init__(self, spark, grow=0, broken=True):
        self.seen, self.grow, self.broken = spark.sparkContext.accumulator(0), grow, broken

    def __call__(self, rows):
        seen, grow, broken = self.seen, self.grow, self.broken

        @F.udf("string")
        def answer(text):
            seen.add(1)
            return "no json" if broken and "x" in text else f'{{"size": {len(text) + grow}}}'

        return rows.withColumn("output_text", answer("text"))


def run(spark, store, texts, extract, **options):
    found = process_documents(documents(spark, texts), store, "n", extract=extract, schema=RECORD, **options).collect()
    return sorted((r.n, r.ingest_status, r.record and r.record.size, r.from_cache) for r in found)


def test_known_documents_come_back_and_nothing_is_stored_twice(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"), buckets=4)
    assert store.read() is None and store.runs() == []
    first = Extractor(spark)
    assert run(spark, store, ["a", "bb", "bb", "x"], first) == [(0, "ok", 1, False), (1, "ok", 2, False), (3, "invalid_json", None, False)]
    assert first.seen.value == 3
    second = Extractor(spark, grow=100)
    assert run(spark, store, ["ccc", "bb", "x", "a"], second) == [
        (0, "ok", 103, False), (1, "ok", 2, True), (2, "invalid_json", None, False), (3, "ok", 1, True)]
    assert second.seen.value == 2 and store.runs() == [1, 2] and store.read().count() == 3
    assert run(spark, store, ["ccc", "bb", "a"], Extractor(spark)) == [(0, "ok", 103, True), (1, "ok", 2, True), (2, "ok", 1, True)]
    assert run(spark, store, [], Extractor(spark)) == []
    assert store.runs() == [1, 2] and store.read().count() == 3


def test_refresh_replaces_and_later_runs_see_it(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"), buckets=3)
    run(spark, store, ["a", "bb"], Extractor(spark))
    assert run(spark, store, ["bb", "ccc"], Extractor(spark, grow=10), force_refresh=True) == [(0, "ok", 12, False), (1, "ok", 13, False)]
    run(spark, store, ["bb"], Extractor(spark, grow=20), force_refresh=True)
    assert sorted(r.record.size for r in store.read().collect()) == [1, 13, 22]
    assert run(spark, store, ["a", "bb", "ccc"], Extractor(spark)) == [(0, "ok", 1, True), (1, "ok", 22, True), (2, "ok", 13, True)]


def test_broken_runs_leave_nothing(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"), buckets=3)
    run(spark, store, ["a"], Extractor(spark))

    def fails(rows):
        return rows.withColumn("output_text", F.raise_error(F.lit("no service")))

    with pytest.raises(Exception, match="no service"):
        run(spark, store, ["a", "bb"], fails)
    # A run that ended while it wrote: files without the marker, and a list of replaced keys that never took effect.
    left = store.read()
    left.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / "store" / "run=2"))
    left.select("document_hash", F.lit(0).alias("bucket")).write.partitionBy("bucket").parquet(str(tmp_path / "store" / "replaced=2"))
    (tmp_path / "store" / "run=2" / "_SUCCESS").unlink()
    assert store.runs() == [1] and store.read().count() == 1
    assert run(spark, store, ["a", "bb"], Extractor(spark)) == [(0, "ok", 1, True), (1, "ok", 2, False)]
    assert store.runs() == [1, 2] and store.read().count() == 2


def test_store_checks_what_it_gets(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("k", 1), (None, 2)], "document_hash string, v int")
    assert store.save(rows) == 1 and store.save(rows) == 0
    with pytest.raises(ValueError, match="repeat"):
        store.save(spark.createDataFrame([("z", 1), ("z", 2)], "document_hash string, v int"))
    with pytest.raises(ValueError, match="columns"):
        store.save(rows.withColumn("w", F.lit(1)))
    with pytest.raises(ValueError):
        ResultStore(spark, "x", buckets=0)
    found = store.find(spark.createDataFrame([("k",), ("other",), (None,)], "document_hash string"))
    assert [tuple(r) for r in found.select("document_hash", "v").collect()] == [("k", 1)]


def test_only_buckets_of_the_keys_are_read(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"), buckets=32)
    store.save(spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("document_hash"), F.col("id").alias("v")))
    key = spark.range(5, 6).select(F.sha2(F.col("id").cast("string"), 256).alias("document_hash"))
    found = store.find(key)
    assert [r.v for r in found.collect()] == [5]
    assert "PartitionFilters: [" in (plan := found._jdf.queryExecution().toString()) and "bucket" in plan.split("PartitionFilters: [")[1][:60]


def test_results_of_a_date_are_written_once(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "resume_id int, status string")
    write_results(rows, path, "2024-01-01")
    write_results(rows, path, "2024-01-02")
    write_results(rows.where("resume_id = 2"), path, "2024-01-01")
    write_results(rows, path, "2024-01-02")
    write_results(rows.limit(0), path, "2024-01-02")
    assert sorted((str(r.run_date), r.resume_id) for r in spark.read.json(path).collect()) == [
        ("2024-01-01", 2), ("2024-01-02", 1), ("2024-01-02", 2)]
