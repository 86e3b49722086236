"""Rules an analysis report must keep: scores, sources, bindings and quoted evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.config import DIMENSION_WEIGHTS
from talentweave.functions import pointers
from talentweave.functions import text as X
from talentweave.functions.rows import explode_rows
from talentweave.operators.recall import _by_value


def dimension_rows(reports: DataFrame) -> DataFrame:
    """Nested reports as one row per (report, dimension)."""
    kinds = F.array(*[
        F.struct(F.lit(name).alias("dimension"), F.col(f"dimensions.{name}").alias("a")) for name in DIMENSION_WEIGHTS
    ])
    return explode_rows(reports, ["report_id"], kinds, "d").select("report_id", "d.dimension", "d.a.*")


def _sources(evidence: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(evidence, lambda e: e["source"])))


def cites_both(evidence: Column) -> Column:
    return F.coalesce(_sources(evidence) == F.array(F.lit("jd"), F.lit("resume")), F.lit(False))


def check_assessments(assessments: DataFrame) -> DataFrame:
    """Assessments that break a rule; ``assessments``: status, score, evidence, missing_information."""
    silent = F.col("status").isin("unknown", "not_applicable")
    rule = (
        F.when(silent & F.col("score").isNotNull(), "score_must_be_null")
        .when(~silent & F.col("score").isNull(), "score_missing")
        .when(~silent & ~cites_both(F.col("evidence")), "must_cite_both_sources")
        .when((F.col("status") == "unknown") & (F.size("missing_information") <= 0), "missing_information_needed")
    )
    return assessments.withColumn("rule", rule).where(F.col("rule").isNotNull())


def check_findings(findings: DataFrame) -> DataFrame:
    return findings.where(~cites_both(F.col("evidence"))).withColumn("rule", F.lit("must_cite_both_sources"))


def check_reports(reports: DataFrame) -> DataFrame:
    """Reports with repeated targets, an overall score without any scored dimension, or no question.

    ``reports``: report_id, target_ids, overall_score, dimension_scores, n_questions.
    """
    unscored = F.forall("dimension_scores", lambda s: s.isNull())
    rules = F.array_compact(F.array(
        F.when(F.size("target_ids") < 1, F.lit("no_target")),
        F.when(F.size(F.array_distinct("target_ids")) != F.size("target_ids"), F.lit("duplicate_target")),
        F.when(F.col("overall_score").isNotNull() & unscored, F.lit("overall_without_dimensions")),
        F.when(F.coalesce("n_questions", F.lit(0)) < 1, F.lit("no_question")),
    ))
    return explode_rows(reports, ["report_id"], rules, "rule")


def check_outputs(reports: DataFrame, inputs: DataFrame) -> DataFrame:
    """Per résumé: a JD reported twice, a target in two reports, a scope that differs from the input.

    ``reports``: resume_id, jd_id, target_ids, analysis_scope; ``inputs``: resume_id, analysis_scope.
    """
    jds = reports.groupBy("resume_id", "jd_id").count().where("count > 1").select(
        "resume_id", F.lit("duplicate_jd").alias("rule"), F.col("jd_id").cast("string").alias("value")
    )
    targets = explode_rows(reports, ["resume_id"], "target_ids", "t").groupBy("resume_id", "t").count()
    twice = targets.where("count > 1").select(
        "resume_id", F.lit("duplicate_target").alias("rule"), F.col("t").alias("value")
    )
    wanted = inputs.select("resume_id", F.col("analysis_scope").alias("_wanted"))
    scopes = reports.select("resume_id", "analysis_scope").distinct().join(wanted, "resume_id").where(
        ~F.col("analysis_scope").eqNullSafe(F.col("_wanted"))
    ).select("resume_id", F.lit("scope_differs").alias("rule"), F.col("analysis_scope").alias("value"))
    return jds.unionByName(twice).unionByName(scopes)


def check_bindings(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Targets whose JD differs between input and output, or that only one of them has."""
    keys = ["resume_id", "target_id"]
    e = expected.select(*keys, F.col("jd_id").alias("expected_jd_id"))
    a = actual.select(*keys, F.col("jd_id").alias("actual_jd_id"))
    return e.join(a, keys, "full_outer").where(~F.col("expected_jd_id").eqNullSafe(F.col("actual_jd_id")))


def weighted_scores(assessments: DataFrame) -> DataFrame:
    """Weighted overall score per report over the scored dimensions; NULL with an unknown dimension.

    Weights and scores of five dimensions are summed as partial aggregates before the exchange.
    """
    weight = _by_value(F.col("dimension"), DIMENSION_WEIGHTS)
    scored = F.col("score").isNotNull()
    return assessments.groupBy("report_id").agg(
        F.sum(F.when(scored, F.col("score") * weight)).alias("_sum"),
        F.sum(F.when(scored, weight)).alias("_weight"),
        F.bool_or(F.col("status") == "unknown").alias("has_unknown"),
        F.count("score").alias("scored_dimensions"),
    ).select(
        "report_id", "has_unknown", "scored_dimensions",
        F.when(~F.col("has_unknown"), F.try_divide(F.col("_sum"), F.col("_weight"))).alias("weighted_score"),
    )


def in_band(status: Column, score: Column) -> Column:
    return (
        ((status == "matched") & score.between(80, 100))
        | ((status == "partially_matched") & (score >= 40) & (score < 80))
        | ((status == "mismatched") & (score >= 0) & (score < 40))
    )


def check_scoring(assessments: DataFrame, reports: DataFrame) -> DataFrame:
    """Scores outside their band, and overall scores that do not follow from the dimensions."""
    bands = assessments.where(F.col("score").isNotNull() & ~F.coalesce(in_band(F.col("status"), F.col("score")), F.lit(False)))
    outside = bands.select("report_id", F.lit("score_outside_band").alias("rule"), F.col("dimension").alias("detail"))
    joined = weighted_scores(assessments).join(reports.select("report_id", "overall_score"), "report_id")
    overall, wanted = F.col("overall_score"), F.col("weighted_score")
    rule = (
        F.when(wanted.isNull(), F.when(overall.isNotNull(), "overall_must_be_null"))
        .when(overall.isNull(), "overall_missing")
        .when(F.abs(overall * 10 - F.rint(overall * 10)) > 1e-8, "overall_not_one_decimal")
        .when(F.abs(overall - wanted) > 0.1, "overall_differs_from_weighted")
    )
    wrong = joined.select("report_id", rule.alias("rule"), F.lit("overall").alias("detail")).where(F.col("rule").isNotNull())
    return outside.unionByName(wrong)


def resolve_evidence(evidence: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence rows with the text their pointer names and why they fail, if they do.

    ``evidence``: keys, source, path, quote. ``documents``: keys plus one column per source: a nested struct, of which each
    document row builds one map of its text leaves, or a VARIANT of any shape, in which pointers are followed.
    There is no row per leaf.
    """
    sources = [f for f in documents.schema.fields if f.name not in keys]
    leaves = documents.select(*keys, *[
        (F.col(f.name) if isinstance(f.dataType, T.VariantType) else pointers.text_leaves(F.col(f.name), f.dataType)).alias("_" + f.name)
        for f in sources
    ])
    leaf = F.lit(None).cast("string")
    for f in sources:
        if isinstance(f.dataType, T.VariantType):
            leaf = F.when(F.col("source") == f.name, pointers.variant_text(F.col("_" + f.name), F.col("path"))).otherwise(leaf)
        elif isinstance(f.dataType, T.StructType):
            leaf = F.when(F.col("source") == f.name, F.try_element_at(F.col("_" + f.name), F.col("path"))).otherwise(leaf)
    located = evidence.join(leaves, keys, "left").withColumn("leaf", leaf)
    problem = F.coalesce(
        F.when(~F.coalesce(F.col("source").isin([f.name for f in sources]), F.lit(False)), "unknown_source"),
        pointers.pointer_problem(F.col("path"), F.col("leaf")),
        F.when(X.is_blank(F.col("quote")), "blank_quote"),
        F.when(~F.contains(F.col("leaf"), F.col("quote")), "quote_not_found"),
    )
    return located.withColumn("problem", problem).drop(*["_" + f.name for f in sources])


def check_evidence_quotes(evidence: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    return resolve_evidence(evidence, documents, keys).where(F.col("problem").isNotNull()).drop("leaf")


def report_evidence(reports: DataFrame) -> DataFrame:
    """All citations of nested reports, one row each, from dimensions, findings and questions."""
    dims = F.concat(*[F.col(f"dimensions.{n}.evidence") for n in DIMENSION_WEIGHTS])
    rest = F.flatten(F.concat(*[
        F.transform(c, lambda x: x["evidence"]) for c in ("strengths", "gaps", "interview_questions")
    ]))
    return explode_rows(reports, ["resume_id", "jd_id"], F.concat(dims, rest), "e").select(
        "resume_id", "jd_id", "e.*"
    )
