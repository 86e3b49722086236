"""Triage of stored model responses and the request payloads that lead to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.functions import strict
from talentweave.functions import text as X
from talentweave.functions.rows import explode_rows


def triage_responses(responses: DataFrame, schema: T.StructType, closed: bool = False) -> DataFrame:
    """First rule that applies gives ``stage``, ``code`` and ``retryable``; all NULL for a usable response.

    ``responses``: n_choices, refusal, finish_reason, has_tool_calls, content. The content is checked against the schema
    at every depth, without conversion; ``closed`` also forbids fields that the schema does not have.
    """
    finish = F.coalesce("finish_reason", F.lit(""))
    code = (
        F.when(F.coalesce("n_choices", F.lit(0)) != 1, "invalid_choices")
        .when((F.coalesce("refusal", F.lit("")) != "") | (finish == "content_filter"), "model_refusal")
        .when(finish == "length", "output_truncated")
        .when((finish != "stop") | F.coalesce("has_tool_calls", F.lit(False)), "unexpected_finish")
        .when(X.is_blank(F.col("content")), "empty_output")
        .when(~X.is_json(F.col("content")), "invalid_json")
        .when(F.size(strict.json_errors(F.col("content"), schema, closed)) > 0, "invalid_schema")
    )
    stage = F.when(F.col("code") == "model_refusal", "llm_call").when(
        F.col("code") == "invalid_schema", "output_validate"
    ).when(F.col("code").isNotNull(), "output_parse")
    retryable = F.when(F.col("code").isNotNull(), ~F.col("code").isin("model_refusal", "output_truncated"))
    return (
        responses.withColumn("code", code).withColumn("stage", stage).withColumn("retryable", retryable)
    )


def analysis_requests(inputs: DataFrame) -> DataFrame:
    """One JSON payload per (résumé, JD): the résumé, that JD and the bindings of that JD only."""
    per_jd = explode_rows(inputs, ["resume_id", "resume", "target_matches"], "matched_jds", "jd")
    own = F.filter("target_matches", lambda t: t["selected_jd_id"] == F.col("jd.jd_id"))
    return per_jd.select(
        "resume_id", F.col("jd.jd_id").alias("jd_id"), F.size(own).alias("n_bindings"),
        F.to_json(F.struct("resume", "jd", own.alias("target_matches")), {"ignoreNullFields": "false"}).alias("payload"),
    )
