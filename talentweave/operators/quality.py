"""Résumé quality: one row per issue, and the roll-up per résumé. Everything but the roll-up is per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.functions import strict
from talentweave.functions.rows import explode_rows
from talentweave.schemas import RESUME

_ISSUE = (
    "array<struct<field_path:string,issue_type:string,severity:string,message:string,"
    "current_value:string,blocks_analysis:boolean>>"
)
# Issue messages.
NO_CONTENT = "未提取到教育、技能、工作或项目经历，可能存在简历解析或LLM抽取失败"
NO_NAME = "未提取到姓名"
NO_CONTACT = "手机号和邮箱均为空"
NO_TARGET = "未提取到目标岗位标题"
NO_EDUCATION = "未提取到教育经历，可能影响学历条件判断"
NO_SCHOOL = "缺少学校名称"
NO_DEGREE = "缺少学历或学位信息，可能影响JD硬条件判断"
NO_JOB_TITLE = "未提取到岗位名称"
NO_DATES = "工作时间信息不完整，可能影响工作年限计算"
EMPTY_PROJECT = "项目经历为空"
NO_EVIDENCE = "教育经历缺少原始文本证据"


def _issue(path: Column, kind: str, message: str | Column, severity: str = "warning", blocks: bool = False,
           value: Column | None = None) -> Column:
    return F.struct(
        path.alias("field_path"), F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
        (F.lit(None) if value is None else value).cast("string").alias("current_value"),
        F.lit(blocks).alias("blocks_analysis"),
    )


def _when(condition: Column, issue: Column) -> Column:
    return F.when(condition, F.array(issue).cast(_ISSUE)).otherwise(F.array().cast(_ISSUE))


def _no_text(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _none(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def _per_entry(entries: Column, prefix: str, checks) -> Column:
    """Issues of every array entry; ``checks(entry, path)`` gives arrays of issues."""
    def one(entry: Column, i: Column) -> Column:
        path = F.concat(F.lit(prefix + "["), i.cast("string"), F.lit("]"))
        return F.concat(*checks(entry, path))

    return F.coalesce(F.flatten(F.transform(entries, one)), F.array().cast(_ISSUE))


def issue_array() -> Column:
    """All issues of a résumé row, in the order in which they are checked."""
    basic, know = F.col("basic_info"), F.col("knowledge_and_experience")
    educations = F.col("education_background.educations")
    at = F.lit
    content = _when(
        _none(educations) & _none(know["skills"]) & _none(know["work_experiences"]) & _none(know["project_experiences"]),
        _issue(at("$"), "low_quality", NO_CONTENT, "error", True),
    )
    basics = F.concat(
        _when(_no_text(basic["name"]), _issue(at("basic_info.name"), "missing_field", NO_NAME)),
        _when(_no_text(basic["phone"]) & _no_text(basic["email"]), _issue(at("basic_info"), "missing_field", NO_CONTACT)),
        _when(_no_text(basic["target_job_title"]), _issue(at("basic_info.target_job_title"), "missing_field", NO_TARGET)),
    )
    education = F.when(
        _none(educations),
        F.array(_issue(at("education_background.educations"), "empty_field", NO_EDUCATION)).cast(_ISSUE),
    ).otherwise(_per_entry(educations, "education_background.educations", lambda e, path: [
        _when(_no_text(e["school"]), _issue(F.concat(path, at(".school")), "missing_field", NO_SCHOOL)),
        _when(_no_text(e["degree"]), _issue(F.concat(path, at(".degree")), "missing_field", NO_DEGREE)),
    ]))
    work = _per_entry(know["work_experiences"], "knowledge_and_experience.work_experiences", lambda e, path: [
        _when(_no_text(e["job_title"]), _issue(F.concat(path, at(".job_title")), "missing_field", NO_JOB_TITLE)),
        _when(_no_text(e["start_date_raw"]) | _no_text(e["end_date_raw"]), _issue(path, "missing_field", NO_DATES)),
    ])
    project = _per_entry(know["project_experiences"], "knowledge_and_experience.project_experiences", lambda e, path: [
        _when(
            _no_text(e["project_name"]) & _none(e["description"]) & _none(e["responsibilities"])
            & _none(e["technologies"]) & _none(e["achievements"]),
            _issue(path, "empty_field", EMPTY_PROJECT),
        ),
    ])
    evidence = _per_entry(educations, "education_background.educations", lambda e, path: [
        _when(_none(e["evidence"]), _issue(F.concat(path, at(".evidence")), "missing_evidence", NO_EVIDENCE)),
    ])
    return F.concat(content, basics, education, work, project, evidence)


def resume_issues(resumes: DataFrame) -> DataFrame:
    return explode_rows(resumes, ["resume_id"], issue_array(), "i").select("resume_id", "i.*")


def resume_quality(resumes: DataFrame) -> DataFrame:
    """Status per résumé; issues never leave their row, so nothing is shuffled."""
    issues = resumes.select("resume_id", issue_array().alias("i"))
    n_blocking = F.size(F.filter("i", lambda x: x["blocks_analysis"]))
    return issues.select(
        "resume_id", F.size("i").alias("issue_count"), n_blocking.alias("blocking_count")
    ).select(
        "resume_id", "issue_count", "blocking_count",
        F.when(F.col("blocking_count") > 0, "review_required").when(F.col("issue_count") > 0, "review_recommended")
        .otherwise("auto_approved").alias("quality_status"),
        (F.col("blocking_count") == 0).alias("can_analyze"),
    )


def schema_errors(rows: DataFrame, column: str, schema: T.StructType = RESUME) -> DataFrame:
    """Blocking schema issues of résumé JSON text, one row per wrong field, at every depth.

    Text that is no JSON gives one issue at ``$``. Unknown fields are allowed.
    """
    issues = F.transform(strict.json_errors(F.coalesce(F.col(column), F.lit("")), schema), schema_issue)
    keep = [c for c in rows.columns if c != column]
    return explode_rows(rows, keep, issues, "i").select(*keep, "i.*")


def schema_issue(found: Column) -> Column:
    """A strict-check error as a quality issue."""
    return F.struct(
        found["path"].alias("field_path"), F.lit("schema_error").alias("issue_type"), F.lit("error").alias("severity"),
        found["message"].alias("message"), found["value"].alias("current_value"), F.lit(True).alias("blocks_analysis"),
    )
