"""The order of the mix, from the mixing stage to packed sequences."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from talentweave.llm import mixing

SCHEMA = "doc_id bigint, text string, source string"


def test_source_shares_hold_in_every_stretch(spark, tmp_path):
    rng = random.Random(8)
    # Sources lie one after the other; ids tell which source a document is of.
    sizes = {"a": 1500, "b": 500, "c": 1000}
    data = [(k * 10**6 + i, " ".join(["w"] * rng.randint(20, 400)), s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    docs = spark.createDataFrame(data, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        corpus_pipeline.mixed_sources(spark, docs, "").write.parquet(str(tmp_path / "mix"))
        mix = spark.read.parquet(str(tmp_path / "mix"))
        rows = mix.select("doc_id", "source", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"),
                          F.size(F.split("text", " ")).alias("n")).collect()
        packed = corpus_pipeline.packed_sequences(spark, mix, "").where("begins").select("doc_id", "sequence_id", "offset").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r.file for r in rows}) > 2
    rows.sort(key=lambda r: (r.file, r.at))
    assert [r.doc_id for r in rows] == [r.doc_id for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset))]
    total, seen, all_seen = Counter(), Counter(), 0
    for r in rows:
        total[r.source] += r.n
    whole = sum(total.values())
    for r in rows:
        seen[r.source] += r.n
        all_seen += r.n
        assert all(abs(seen[s] - total[s] / whole * all_seen) < 8 * mixing.BLOCK_WORDS for s in total)
