"""Views over tables of any proportion."""

from pyspark.sql import functions as F

from workload import fixtures as fx


def _tables(spark, folder, vectors, parts):
    spark.range(vectors).select(
        F.col("id").alias("vec_id"), F.array(F.lit(1.0).cast("float"), F.col("id").cast("float")).alias("embedding"), (F.col("id") % 7).alias("label")
    ).write.parquet(f"{folder}/embeddings.parquet")
    spark.range(parts).select(
        F.col("id").alias("p_partkey"), F.concat(F.lit("part "), F.sha2(F.col("id").cast("string"), 512)).alias("p_name"), F.lit("brand").alias("p_brand"),
        F.lit("type").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size")).write.parquet(f"{folder}/part.parquet")


def test_queries_that_are_few_beside_the_parts(spark, tmp_path):
    _tables(spark, tmp_path, 10, 30000)
    rows = fx.view(spark, str(tmp_path), "fx_queries").drop("embedding").collect()
    assert sorted((r.resume_id, r.query_id, r.query_order) for r in rows) == [(i // 5, f"q{i}", i % 5) for i in range(10)]


def test_the_number_of_parts_keeps_its_type(spark, tmp_path):
    _tables(spark, tmp_path, 10, 300)
    spark.range(5).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") * 200).alias("user_id"),
        F.lit("click").alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    view = fx.view(spark, str(tmp_path), "fx_decisions")
    assert dict(view.dtypes)["jd_id"] == "bigint"
    assert {r.event_id: r.jd_id for r in view.collect()} == {0: 0, 1: 1, 2: 100, 3: 3, 4: 200}
