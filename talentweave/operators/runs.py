"""Analysis jobs and their attempt log, folded by sets instead of by a state machine.

The first ``max_retries + 1`` rows of a job decide it: a success or a final failure among them ends it.
Spark keeps just those rows per job before the exchange, so a job with a huge log stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave.config import RetryConfig
from talentweave.functions import text as X

JOB_KEYS = ["resume_id", "jd_id"]
#: States of a job.
JOB_STATUSES = ("pending", "running", "retry_pending", "succeeded", "failed")


def analysis_jobs(bindings: DataFrame) -> DataFrame:
    """Distinct JDs to analyse per résumé, ordered by first appearance; several targets share one job."""
    return bindings.groupBy("resume_id", F.col("selected_jd_id").alias("jd_id")).agg(
        F.min("target_pos").alias("first_pos"), F.count("*").alias("target_count")
    )


def numbered_attempts(attempts: DataFrame, cfg: RetryConfig = RetryConfig()) -> DataFrame:
    """The deciding rows of each job with their 1-based ``attempt_number``; a column ``round`` goes before the time."""
    known = [c for c in ("round", "ts", "event_id") if c in attempts.columns]
    order = Window.partitionBy(*JOB_KEYS).orderBy(*known)
    return attempts.withColumn("attempt_number", F.row_number().over(order)).where(
        F.col("attempt_number") <= cfg.max_retries + 1
    )


def attempt_fold(attempts: DataFrame, cfg: RetryConfig = RetryConfig()) -> DataFrame:
    """Status, attempts made, retries and errors per job, up to its first terminal row."""
    n = F.col("attempt_number")
    ends = F.col("succeeded") | ~F.col("retryable") | (n > cfg.max_retries)
    jobs = numbered_attempts(attempts, cfg).groupBy(*JOB_KEYS).agg(
        F.min(F.when(ends, n)).alias("_end"), F.max(n).alias("_seen"),
        F.min(F.when(F.col("succeeded"), n)).alias("_success"),
        F.map_from_entries(F.collect_list(F.struct(n, F.struct("ts", "event_id")))).alias("_at"),
    ).withColumn("attempts", F.coalesce("_end", "_seen")).withColumn("_last", F.element_at("_at", F.col("attempts")))
    done = F.col("_success").isNotNull() & (F.col("_success") == F.col("_end"))
    return jobs.select(
        *JOB_KEYS,
        F.when(done, "succeeded").when(F.col("_end").isNotNull(), "failed").otherwise("retry_pending").alias("status"),
        F.col("attempts").cast("long").alias("attempts"),
        (F.col("attempts") - 1).cast("long").alias("retry_count"),
        (F.col("attempts") - F.when(done, 1).otherwise(0)).cast("long").alias("error_count"),
        F.col("_last.ts").alias("last_ts"), F.col("_last.event_id").alias("last_event_id"),
    )


def check_attempts(attempts: DataFrame, folded: DataFrame) -> DataFrame:
    """Attempts logged after their job had ended."""
    ended = folded.where(F.col("status") != "retry_pending").select(*JOB_KEYS, "last_ts", "last_event_id")
    later = (F.col("ts") > F.col("last_ts")) | (
        (F.col("ts") == F.col("last_ts")) & (F.col("event_id") > F.col("last_event_id"))
    )
    return attempts.join(ended, JOB_KEYS).where(later).select(
        *JOB_KEYS, "event_id", F.lit("attempt_after_end").alias("rule")
    )


def job_rules(cfg: RetryConfig) -> dict[str, Column]:
    """Conditions under which a stored job state is wrong, by name."""
    tries, errors, status = F.col("retry_count"), F.col("errors"), F.col("status")
    logged, final = F.size(errors), F.try_element_at(errors, F.lit(-1))
    waits, gave_up, done = (status == s for s in ("retry_pending", "failed", "succeeded"))
    one_more = (waits | gave_up).cast("int")
    budget_left = tries < cfg.max_retries
    out_of_step = F.exists(F.transform(errors, lambda e, i: e["attempt_number"] != i + 1), lambda wrong: wrong)
    return {
        "unknown_status": ~status.isin(*JOB_STATUSES),
        # the report and its job
        "report_iff_succeeded": done != F.col("has_report"),
        "report_of_other_jd": F.col("has_report") & ~F.col("report_jd_id").eqNullSafe(F.col("jd_id")),
        # the log and the counters
        "pending_with_history": (status == "pending") & ((tries > 0) | (logged > 0)),
        "error_count": logged != tries + one_more,
        "attempt_numbers": out_of_step,
        # what may follow an error
        "run_after_final_error": F.exists(F.slice(errors, F.lit(1), F.greatest(tries, F.lit(0))), lambda e: ~e["retryable"]),
        "retry_of_final_error": waits & ~final["retryable"],
        # the budget
        "over_budget": tries > cfg.max_retries,
        "budget_spent": waits & ~budget_left,
        "failed_with_budget": gave_up & final["retryable"] & budget_left,
    }


def check_job_states(states: DataFrame, cfg: RetryConfig = RetryConfig()) -> DataFrame:
    """Stored job states that break a rule, with the first one. A rule that NULL leaves undecided counts as broken.

    ``states``: resume_id, jd_id, status, has_report, retry_count, errors array<struct<attempt_number,retryable>>, and
    optionally report_jd_id.
    """
    rows = states if "report_jd_id" in states.columns else states.withColumn("report_jd_id", F.col("jd_id"))
    broken = F.array_compact(F.array(*[F.when(F.coalesce(wrong, F.lit(True)), F.lit(name)) for name, wrong in job_rules(cfg).items()]))
    return rows.withColumn("rule", F.get(broken, F.lit(0))).where(F.col("rule").isNotNull()).select(*JOB_KEYS, "status", "rule")


def check_job_cover(jobs: DataFrame, bindings: DataFrame) -> DataFrame:
    """Bound JDs without a job, and jobs of JDs that are not bound."""
    bound = bindings.select("resume_id", F.col("selected_jd_id").alias("jd_id")).distinct().withColumn("_bound", F.lit(True))
    found = jobs.select(*JOB_KEYS).distinct().withColumn("_job", F.lit(True))
    rule = F.when(F.col("_job").isNull(), "job_missing").when(F.col("_bound").isNull(), "job_not_bound")
    return bound.join(found, JOB_KEYS, "full_outer").withColumn("rule", rule).where(F.col("rule").isNotNull()).select(*JOB_KEYS, "rule")


def job_states(jobs: DataFrame, folded: DataFrame) -> DataFrame:
    """All jobs with their folded status; a job without attempts is pending."""
    return jobs.join(folded, JOB_KEYS, "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def runnable_jobs(states: DataFrame) -> DataFrame:
    return states.where(F.col("status").isin("pending", "retry_pending"))


def run_status(states: DataFrame) -> DataFrame:
    """Per résumé: job counts, whether all jobs have ended, and the status of the run."""
    counts = states.groupBy("resume_id").agg(
        F.count("*").alias("job_count"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded_count"),
        F.bool_and(F.col("status").isin("succeeded", "failed")).alias("finished"),
    )
    return counts.withColumn(
        "run_status",
        F.when(~F.col("finished"), "running").when(F.col("succeeded_count") == F.col("job_count"), "succeeded")
        .when(F.col("succeeded_count") > 0, "partial_failed").otherwise("failed"),
    )


def retry_schedule(folded: DataFrame, hints: DataFrame | None = None, cfg: RetryConfig = RetryConfig()) -> DataFrame:
    """Delay and earliest time of the next attempt of every job that waits for one. ``hints``: retry_after_seconds by job."""
    waiting = folded.where(F.col("status") == "retry_pending")
    hint = F.lit(None).cast("double")
    if hints is not None:
        waiting = waiting.join(hints, JOB_KEYS, "left")
        hint = F.col("retry_after_seconds")
    delay = X.backoff(F.col("retry_count"), hint, cfg.base_delay, cfg.max_delay)
    return waiting.withColumn("delay_seconds", delay).withColumn(
        "next_ts", F.col("last_ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("delay_seconds").cast("decimal(18,6)"))
    )


def final_outputs(states: DataFrame, status: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """Reports of the résumés whose jobs all succeeded, in job order."""
    ready = status.where(F.col("run_status") == "succeeded").select("resume_id")
    rows = states.join(ready, "resume_id", "left_semi")
    item = F.struct("first_pos", "jd_id")
    if reports is not None:
        rows = rows.join(reports, JOB_KEYS)
        item = F.struct("first_pos", "jd_id", "report")
    return rows.groupBy("resume_id").agg(F.array_sort(F.collect_list(item)).alias("job_analyses"))
