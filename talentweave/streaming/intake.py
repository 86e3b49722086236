"""Documents as they land: each content hash is processed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talentweave.plans.storage import exists
from talentweave.sources.intake import with_hash

PREFIX_DIGITS = 2  # hexadecimal digits of the hash that name a folder


def start_intake(
    documents: DataFrame, column: str, event_time: str, path: str, checkpoint: str, *, delay: str = "1 day", prefix_digits: int = PREFIX_DIGITS
) -> StreamingQuery:
    """Append every new document of a stream to the table at ``path``, in folders by the first digits of its hash.

    Copies inside the watermark are dropped by the state store. For copies of what was stored earlier, a batch reads the
    hashes of just those folders that its own hashes fall into. A batch that is run again overwrites its own
    files and nothing else.
    """
    hashed = with_hash(documents, column).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["document_hash"])

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("prefix", F.concat(F.lit("p"), F.substring("document_hash", 1, prefix_digits)))
        if exists(spark, path):
            touched = [r.prefix for r in fresh.select("prefix").distinct().collect()]  # at most 16 ** prefix_digits
            earlier = spark.read.parquet(path).where(F.col("prefix").isin(touched) & (F.col("batch_id") != batch_id))
            fresh = fresh.join(earlier.select("document_hash"), "document_hash", "left_anti")
        (
            fresh.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("prefix", "batch_id").parquet(path)
        )

    return (
        hashed.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
