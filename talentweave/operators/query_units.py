"""Retrieval queries of one target: title, one per work entry, one per project, one for all skills.

Units are built as an array inside the (target, résumé) row and exploded once: no shuffle beyond the
join of targets with résumés.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentweave.config import PROJECT, SKILLS, TITLE, WORK, QueryConfig
from talentweave.functions import text as X
from talentweave.functions.rows import explode_rows

# Warnings for query kinds that could not be built.
NO_WORK = "未构造出工作经历检索单元"
NO_PROJECT = "未构造出项目经历检索单元"
NO_SKILLS = "未构造出技能检索单元"
ONLY_TITLE = "简历缺少可用经历或技能，本次仅使用申请岗位名称召回"

_UNIT = (
    "array<struct<query_id:string,query_type:string,text:string,resume_evidence_text:string,"
    "source_index:int,weight:double>>"
)


def _title() -> Column:
    return X.collapse_ws(F.col("requested_job_title"))


def _unit(query_id: Column, kind: str, text: Column, evidence: Column, index: Column) -> Column:
    return F.struct(
        query_id.alias("query_id"), F.lit(kind).alias("query_type"), text.alias("text"),
        evidence.cast("string").alias("resume_evidence_text"), index.cast("int").alias("source_index"),
        F.lit(1.0).alias("weight"),
    )


def title_units() -> Column:
    query_id = F.concat(F.col("target_id"), F.lit(":title"))
    text = F.concat(F.lit("申请岗位："), F.col("_title"))
    return F.array(_unit(query_id, TITLE, text, F.lit(None), F.lit(None))).cast(_UNIT)


def _evidence_unit(cfg: QueryConfig, suffix: Column, kind: str, label: str, evidence: Column, index: Column) -> Column:
    text = F.concat(F.lit("申请岗位："), F.col("_title"), F.lit("\n" + label + "："), evidence)
    return _unit(
        F.concat(F.col("target_id"), F.lit(":"), suffix), kind,
        X.truncate(text, cfg.max_chars), X.truncate(evidence, cfg.max_chars), index,
    )


def _from_entries(cfg: QueryConfig, entries: Column, describe, kind: str, prefix: str, label: str) -> Column:
    """One unit per entry whose evidence is long enough; the entry keeps its array position."""
    described = F.transform(
        entries, lambda e, i: F.struct(X.strip(describe(e)).alias("evidence"), i.alias("index"))
    )
    valid = F.filter(described, lambda d: F.char_length(d["evidence"]) >= cfg.min_chars)
    units = F.transform(valid, lambda d: _evidence_unit(
        cfg, F.concat(F.lit(prefix), d["index"].cast("string")), kind, label, d["evidence"], d["index"]
    ))
    return F.coalesce(units.cast(_UNIT), F.array().cast(_UNIT))


def _describe_work(e: Column) -> Column:
    return F.concat_ws(
        "；",
        X.labelled("岗位", X.collapse_ws(e["job_title"])),
        X.labelled("部门", X.collapse_ws(e["department"])),
        X.labelled_list("工作职责", X.clean_list(e["responsibilities"])),
        X.labelled_list("工作成果", X.clean_list(e["achievements"])),
    )


def _describe_project(e: Column) -> Column:
    return F.concat_ws(
        "；",
        X.labelled("项目名称", X.collapse_ws(e["project_name"])),
        X.labelled_list("项目描述", X.clean_list(e["description"])),
        X.labelled_list("项目职责", X.clean_list(e["responsibilities"])),
        X.labelled_list("项目技术", X.clean_list(e["technologies"])),
        X.labelled_list("项目成果", X.clean_list(e["achievements"])),
    )


def work_units(cfg: QueryConfig = QueryConfig()) -> Column:
    return _from_entries(
        cfg, F.col("knowledge_and_experience.work_experiences"), _describe_work, WORK, "work_", "候选人工作经历"
    )


def project_units(cfg: QueryConfig = QueryConfig()) -> Column:
    return _from_entries(
        cfg, F.col("knowledge_and_experience.project_experiences"), _describe_project, PROJECT, "project_",
        "候选人项目经历",
    )


def skills_units(cfg: QueryConfig = QueryConfig()) -> Column:
    skills = X.clean_list(F.col("knowledge_and_experience.skills.skill"))
    evidence = F.array(X.labelled_list("技能与能力", skills))
    valid = F.filter(evidence, lambda e: F.char_length(e) >= cfg.min_chars)
    return F.transform(
        valid, lambda e: _evidence_unit(cfg, F.lit("skills"), SKILLS, "候选人技能", e, F.lit(None))
    ).cast(_UNIT)


def query_units(targets: DataFrame, resumes: DataFrame, cfg: QueryConfig = QueryConfig()) -> DataFrame:
    """All units of every target, one per distinct text (first kind wins), in ``query_order``."""
    return explode_units(unit_arrays(targets, resumes, cfg))


def unit_arrays(targets: DataFrame, resumes: DataFrame, cfg: QueryConfig = QueryConfig()) -> DataFrame:
    """One row per target with its ``units`` array and its build ``warnings``."""
    joined = targets.join(resumes.select("resume_id", "knowledge_and_experience"), "resume_id").withColumn(
        "_title", _title()
    ).where(F.col("_title") != "")
    built = (
        joined.withColumn("_work", work_units(cfg))
        .withColumn("_project", project_units(cfg))
        .withColumn("_skills", skills_units(cfg))
        .withColumn("_all", F.concat(title_units(), "_work", "_project", "_skills"))
        .withColumn("_texts", F.col("_all.text"))
        .withColumn("units", F.filter("_all", lambda u, i: F.array_position(F.col("_texts"), u["text"]) == i + 1))
    )

    def when_empty(name: str, warning: str) -> Column:
        return F.when(F.size(name) == 0, F.lit(warning))

    warnings = F.array_compact(F.array(
        when_empty("_work", NO_WORK), when_empty("_project", NO_PROJECT), when_empty("_skills", NO_SKILLS),
        F.when(F.size("units") == 1, F.lit(ONLY_TITLE)),
    ))
    return built.withColumn("warnings", warnings).select(
        *targets.columns, F.col("_title").alias("clean_title"), "units", "warnings"
    )


def explode_units(arrays: DataFrame) -> DataFrame:
    keep = ["resume_id", "target_id", F.col("clean_title").alias("requested_job_title")]
    return explode_rows(arrays, keep, "units", "u", "query_order").select("resume_id", "target_id", "requested_job_title", "query_order", "u.*")


def units_of_kind(targets: DataFrame, resumes: DataFrame, kind: str, cfg: QueryConfig = QueryConfig()) -> DataFrame:
    """Units of one kind before texts are made distinct across kinds."""
    arrays = {
        TITLE: lambda: title_units(), WORK: lambda: work_units(cfg),
        PROJECT: lambda: project_units(cfg), SKILLS: lambda: skills_units(cfg),
    }
    joined = targets.join(resumes.select("resume_id", "knowledge_and_experience"), "resume_id").withColumn(
        "_title", _title()
    ).where(F.col("_title") != "")
    keep = ["resume_id", "target_id", F.col("_title").alias("requested_job_title")]
    return explode_rows(joined, keep, arrays[kind](), "u").select("resume_id", "target_id", "requested_job_title", "u.*")


def check_required_text(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per blank or NULL required field, naming the field."""
    missing = F.array_compact(F.array(*[F.when(X.is_blank(F.col(f)), F.lit(f)) for f in fields]))
    return explode_rows(rows, keys, missing, "field")
