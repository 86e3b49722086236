"""Requested positions: normalise the free text and make one row per target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave.config import TITLE_SUFFIXES
from talentweave.functions import text as X
from talentweave.functions.rows import explode_rows


def normalize_intents(
    resumes: DataFrame, column: str = "target_job_title", suffixes: tuple[str, ...] = TITLE_SUFFIXES
) -> DataFrame:
    """Add ``job_titles`` and ``is_multi_intent``; all work is per row."""
    no_titles = F.array().cast("array<string>")
    staged = (
        resumes.withColumn("_cleaned", X.collapse_ws(F.col(column)))
        .withColumn("_strong", X.split_clean(F.col("_cleaned"), X.STRONG_SEPARATORS))
        .withColumn("_slash", X.split_clean(F.col("_cleaned"), X.SLASHES))
        .withColumn("_by_slash", X.slash_guard(F.col("_slash"), suffixes))
    )
    empty = F.coalesce(F.col("_cleaned"), F.lit("")) == ""
    strong = F.size("_strong") > 1
    return (
        staged.withColumn(
            "job_titles",
            F.when(empty, no_titles)
            .when(strong, F.array_distinct("_strong"))
            .when(F.col("_by_slash"), F.array_distinct("_slash"))
            .otherwise(F.array("_cleaned")),
        )
        .withColumn("is_multi_intent", ~empty & (strong | F.col("_by_slash")))
        .drop("_cleaned", "_strong", "_slash", "_by_slash")
    )


def explode_targets(intents: DataFrame) -> DataFrame:
    """``(resume_id, target_id, target_pos, requested_job_title)``, targets numbered from 1."""
    return explode_rows(intents, ["resume_id"], "job_titles", "requested_job_title", "pos").select(
        "resume_id",
        F.concat(F.lit("target_"), (F.col("pos") + 1).cast("string")).alias("target_id"),
        (F.col("pos") + 1).alias("target_pos"),
        "requested_job_title",
    )


def reject_without_targets(intents: DataFrame) -> DataFrame:
    return intents.where(F.size("job_titles") == 0).select(
        "resume_id", F.lit("no_valid_target_title").alias("reason")
    )
