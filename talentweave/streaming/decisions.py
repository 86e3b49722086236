"""Review events as they arrive: the winning event per target, and every event that changed nothing.

Each batch is judged, folded and merged with the stored winners by a minimum over (ts, event_id), so the result does
not depend on the order of arrival and equals the batch fold on the same events. An event that comes late but counts
as earlier replaces the stored winner, which then is a reject.

Winners live in buckets of targets. A batch rewrites only buckets that it touches, as a new version, and then drops the
versions before the last one, so storage stays proportional to the decided targets and no state store grows. A batch that is
run again starts from the version before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talentweave.config import TARGET_KEYS
from talentweave.operators.state import judged_decisions
from talentweave.plans.storage import drop_tables, exists

BUCKETS = 64
EVENT = ["ts", "event_id", "action", "jd_id", "reason"]
REJECT = [*TARGET_KEYS, *EVENT, "reason_code"]


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(*TARGET_KEYS), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Stored winners, the last version of each bucket (before a batch)."""
    if not exists(spark, path):
        return None
    stored = spark.read.parquet(path)
    stored = stored if before is None else stored.where(F.col("batch_id") < before)
    last = stored.groupBy("bucket").agg(F.max("batch_id").alias("batch_id"))
    return stored.join(last, ["bucket", "batch_id"])


def start_decisions(
    events: DataFrame, state: DataFrame, candidates: DataFrame, path: str, checkpoint: str, *, buckets: int = BUCKETS
) -> StreamingQuery:
    """Keep the winners of a stream of events at ``path/winners`` and its rejects at ``path/rejects``."""
    judged = judged_decisions(state, candidates, events)
    winners_at, rejects_at = f"{path}/winners", f"{path}/rejects"

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        usable = batch.where("reason_code IS NULL").select(*TARGET_KEYS, *EVENT).withColumn("bucket", _bucket(buckets))
        touched = [r.bucket for r in usable.select("bucket").distinct().collect()]  # at most ``buckets``
        rows = usable.withColumn("stored", F.lit(False))
        before = _versions(spark, winners_at, batch_id)
        if before is not None:
            held = before.where(F.col("bucket").isin(touched)).select(*TARGET_KEYS, *EVENT, "bucket", F.lit(True).alias("stored"))
            rows = rows.unionByName(held)
        first = rows.groupBy("bucket", *TARGET_KEYS).agg(F.min(F.struct(*EVENT)).alias("w")).persist()
        (
            first.select(*TARGET_KEYS, "w.*", "bucket", F.lit(batch_id).cast("long").alias("batch_id")).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(winners_at)
        )
        # What lost now: events of this batch, and stored winners that an earlier event has replaced.
        won = first.select(*TARGET_KEYS, F.col("w.event_id").alias("_won"))
        late = rows.join(won, TARGET_KEYS).where("event_id <> _won").withColumn("reason_code", F.lit("target_not_pending"))
        lost = batch.where("reason_code IS NOT NULL").select(*REJECT).unionByName(late.select(*REJECT))
        lost.write.mode("overwrite").parquet(f"{rejects_at}/batch_id={batch_id}")
        _drop_old_versions(spark, winners_at, batch_id)
        first.unpersist()
        batch.unpersist()

    return (
        judged.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _drop_old_versions(spark: SparkSession, path: str, batch_id: int) -> None:
    """Delete what neither this batch nor its repetition reads: of the versions before it, all but the last per bucket."""
    if not exists(spark, path):
        return
    found = [(r.bucket, r.batch_id) for r in spark.read.parquet(path).select("bucket", "batch_id").distinct().collect()]
    last: dict[int, int] = {}
    for bucket, version in found:
        if version < batch_id:
            last[bucket] = max(version, last.get(bucket, -1))
    drop_tables(spark, [f"{path}/bucket={b}/batch_id={v}" for b, v in found if v < last.get(b, -1)])


def current_winners(spark: SparkSession, path: str) -> DataFrame:
    """Latest winner per target."""
    return _versions(spark, f"{path}/winners").select(
        *TARGET_KEYS, "event_id", "action", F.col("jd_id").alias("chosen_jd_id"), "reason")


def stream_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Events that changed nothing, each with its reason."""
    return spark.read.parquet(f"{path}/rejects").select(*REJECT)
