"""Analysis inputs: cleaned résumé, distinct JDs and their bindings, one row per résumé.

Phone, e-mail, links and source evidence of the résumé are left out by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentweave.functions import text as X


def _optional(parent: Column, *names: str) -> list[Column]:
    return [X.clean_optional(parent[n]).alias(n) for n in names]


def _texts(c: Column) -> Column:
    return X.clean_list(c, collapse=False)


def _rows(entries: Column, build) -> Column:
    return F.filter(F.transform(entries, build), lambda x: x.isNotNull())


def clean_resume() -> Column:
    """Expression over the columns of a résumé row."""
    knowledge, other = F.col("knowledge_and_experience"), F.col("other_info")
    basic = F.col("basic_info")
    education = _rows(F.col("education_background.educations"), lambda e: F.struct(
        *_optional(e, "school", "degree", "major", "start_date_raw", "end_date_raw"),
        _texts(e["description"]).alias("description"),
    ))
    work = _rows(knowledge["work_experiences"], lambda e: F.struct(
        *_optional(e, "company", "job_title", "department", "start_date_raw", "end_date_raw"),
        _texts(e["responsibilities"]).alias("responsibilities"), _texts(e["achievements"]).alias("achievements"),
    ))
    project = _rows(knowledge["project_experiences"], lambda e: F.struct(
        *_optional(e, "project_name", "start_date_raw", "end_date_raw"),
        *[_texts(e[n]).alias(n) for n in ("description", "responsibilities", "technologies", "achievements")],
    ))
    languages = F.transform(
        F.filter(other["languages"], lambda x: ~X.is_blank(x["language"])),
        lambda x: F.struct(X.strip(x["language"]).alias("language"), X.clean_optional(x["level"]).alias("level")),
    )
    return F.struct(
        X.clean_optional(basic["name"]).alias("candidate_name"),
        X.clean_optional(basic["location"]).alias("location"),
        X.clean_optional(basic["target_job_title"]).alias("declared_target_job_title"),
        education.alias("educations"),
        _texts(knowledge["skills"]["skill"]).alias("skills"),
        work.alias("work_experiences"),
        project.alias("project_experiences"),
        _texts(other["certificates"]["name"]).alias("certificates"),
        _texts(other["awards"]["name"]).alias("awards"),
        languages.alias("languages"),
        _texts(other["publications"]).alias("publications"),
        _texts(other["self_evaluation"]).alias("self_evaluation"),
        _texts(other["other"]).alias("other_information"),
    )


def jd_clean(jd: DataFrame) -> DataFrame:
    """Cleaned JD as ``jd`` struct per ``jd_id``, with ``problem`` where a required field is missing."""
    duties = F.coalesce("responsibilities", F.array().cast(jd.schema["responsibilities"].dataType))
    cleaned = F.transform(duties, lambda r: F.struct(
        r["sequence"].alias("sequence"), X.clean_optional(r["description"]).alias("description"),
        _texts(r["tasks"]).alias("tasks"), r["time_percentage"].alias("time_percentage"),
    ))
    problem = (
        F.when(X.is_blank(F.col("job_title")), "missing_job_title")
        .when(F.exists("_duties", lambda r: r.isNull() | r["description"].isNull()), "responsibility_without_description")
    )
    return jd.withColumn("_duties", cleaned).select(
        F.col("id").alias("jd_id"),
        F.struct(
            F.col("id").alias("jd_id"), X.clean_optional(F.col("job_title")).alias("job_title"),
            X.clean_optional(F.col("department")).alias("department"), F.col("_duties").alias("responsibilities"),
            F.struct(
                *[X.clean_optional(F.col(n)).alias(n)
                  for n in ("minimum_education", "education_background", "work_experience_raw")],
                _texts(F.col("competencies")).alias("competencies"),
            ).alias("qualification"),
        ).alias("jd"),
        problem.alias("problem"),
    )


def _with_jds(bindings: DataFrame, jds: DataFrame) -> DataFrame:
    problem = F.when(F.col("jd").isNull(), "jd_missing").otherwise(F.col("problem"))
    problem = F.when(F.col("source").isNull(), "unknown_source").otherwise(problem)
    return bindings.join(
        jds.withColumnRenamed("jd_id", "selected_jd_id"), "selected_jd_id", "left"
    ).withColumn("problem", problem)


def input_rejects(bindings: DataFrame, jds: DataFrame, resumes: DataFrame) -> DataFrame:
    """Bindings that keep their résumé from being analysed, with the reason."""
    lost = bindings.join(resumes.select("resume_id"), "resume_id", "left_anti").select(
        "resume_id", "target_id", "selected_jd_id", F.lit("resume_missing").alias("reason")
    )
    return _with_jds(bindings, jds).where(F.col("problem").isNotNull()).select(
        "resume_id", "target_id", "selected_jd_id", F.col("problem").alias("reason")
    ).unionByName(lost)


def analysis_inputs(bindings: DataFrame, jds: DataFrame, resumes: DataFrame) -> DataFrame:
    """``(resume_id, analysis_scope, resume, matched_jds, target_matches)`` for résumés without rejects."""
    rows = _with_jds(bindings, jds)
    grouped = rows.groupBy("resume_id").agg(
        F.first("analysis_scope").alias("analysis_scope"),
        F.bool_or(F.col("problem").isNotNull()).alias("_bad"),
        F.array_sort(F.collect_list(F.struct(
            "target_pos", "target_id", "requested_job_title", "selected_jd_id", "source", "human_confirmed", "jd",
        ))).alias("_rows"),
    ).where(~F.col("_bad"))
    ids = F.array_distinct(F.col("_rows.selected_jd_id"))
    return grouped.withColumn("_ids", ids).join(resumes, "resume_id").select(
        "resume_id", "analysis_scope", clean_resume().alias("resume"),
        F.transform("_ids", lambda i: F.get(F.filter(F.col("_rows"), lambda r: r["selected_jd_id"] == i), F.lit(0))["jd"])
        .alias("matched_jds"),
        F.transform("_rows", lambda r: F.struct(
            r["target_id"].alias("target_id"), r["requested_job_title"].alias("requested_job_title"),
            r["selected_jd_id"].alias("selected_jd_id"), r["source"].alias("source"),
            r["human_confirmed"].alias("human_confirmed"),
        )).alias("target_matches"),
    )


def reference_problems(bindings: DataFrame, jds: DataFrame) -> DataFrame:
    """Broken references of analysis inputs given as tables.

    ``bindings``: resume_id, target_id, selected_jd_id; ``jds``: resume_id, jd_id. Reports missing JDs,
    target ids bound twice and JDs listed twice.
    """
    missing = bindings.join(
        jds.select("resume_id", F.col("jd_id").alias("selected_jd_id")), ["resume_id", "selected_jd_id"], "left_anti"
    ).select("resume_id", F.lit("missing_jd").alias("problem"), F.col("selected_jd_id").cast("string").alias("value"))
    twice = bindings.groupBy("resume_id", "target_id").count().where("count > 1").select(
        "resume_id", F.lit("duplicate_target").alias("problem"), F.col("target_id").alias("value")
    )
    again = jds.groupBy("resume_id", "jd_id").count().where("count > 1").select(
        "resume_id", F.lit("duplicate_jd").alias("problem"), F.col("jd_id").cast("string").alias("value")
    )
    return missing.distinct().unionByName(twice).unionByName(again)
