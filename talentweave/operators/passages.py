"""JD text passages for pair scoring, packed per JD row without a shuffle or a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentweave.config import SECTION_PRIORITY, PassageConfig
from talentweave.functions import text as X
from talentweave.functions.rows import explode_rows

_PASSAGES = "array<struct<section:string,text:string>>"


def _lines(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def _pack(header: Column, prefix: Column, lines: Column, limit: int) -> Column:
    """Fill passages line by line; a line that would pass the limit opens the next passage.

    Only the body of the open passage and its length are carried; the header is put in front at the end.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("body"),
    )

    def add(state: Column, raw: Column) -> Column:
        line = X.rstrip(F.substring(raw, 1, limit))
        grown = F.char_length(header) + F.char_length(state["body"]) + F.char_length(line) + 2
        opens = state["body"].isNotNull() & (grown > limit)
        return F.struct(
            F.when(opens, F.concat(state["done"], F.array(state["body"]))).otherwise(state["done"]).alias("done"),
            F.when(opens | state["body"].isNull(), line)
            .otherwise(F.concat(state["body"], F.lit("\n"), line)).alias("body"),
        )

    bodies = F.aggregate(lines, start, add, lambda s: F.concat(s["done"], F.array_compact(F.array(s["body"]))))
    return F.transform(bodies, lambda body, i: F.struct(
        F.concat(prefix, F.lit("_part_"), i.cast("string")).alias("section"),
        X.rstrip(F.substring(F.concat(header, F.lit("\n"), body), 1, limit)).alias("text"),
    ))


def jd_documents(jd: DataFrame, cfg: PassageConfig = PassageConfig()) -> DataFrame:
    """``(jd_id, job_title, department, title_passage, passages)`` for every JD with an id and a title."""
    clean = lambda name: X.collapse_ws(F.col(name))
    header = F.col("title_passage")
    rows = (
        jd.withColumn("_title", clean("job_title"))
        .where(F.col("id").isNotNull() & (F.coalesce("_title", F.lit("")) != ""))
        .withColumn("_department", F.nullif(clean("department"), F.lit("")))
        .withColumn("title_passage", F.concat_ws(
            "\n", F.concat(F.lit("公司岗位名称："), "_title"), F.concat(F.lit("所属部门："), "_department")
        ))
        .withColumn("_qualification", _lines(
            X.labelled("最低学历", clean("minimum_education")),
            X.labelled("专业背景", clean("education_background")),
            X.labelled("工作经验要求", clean("work_experience_raw")),
        ))
        .withColumn("_duties", F.transform(
            F.coalesce("responsibilities", F.array().cast(jd.schema["responsibilities"].dataType)),
            lambda r: F.concat(
                _lines(X.labelled("岗位职责", X.collapse_ws(r["description"]))),
                F.transform(X.clean_list(r["tasks"]), lambda t: F.concat(F.lit("具体任务："), t)),
            ),
        ))
        .withColumn("_competency", F.transform(
            X.clean_list(F.col("competencies")), lambda t: F.concat(F.lit("胜任能力："), t)
        ))
    )
    packed = F.concat(
        _pack(header, F.lit("qualification"), F.col("_qualification"), cfg.max_chars),
        F.flatten(F.transform("_duties", lambda lines, i: _pack(
            header, F.concat(F.lit("responsibility_"), i.cast("string")), lines, cfg.max_chars
        ))),
        _pack(header, F.lit("competency"), F.col("_competency"), cfg.max_chars),
    ).cast(_PASSAGES)
    title_only = F.array(F.struct(F.lit("title_only").alias("section"), header.alias("text"))).cast(_PASSAGES)
    return rows.withColumn("_packed", packed).select(
        F.col("id").alias("jd_id"), F.col("_title").alias("job_title"), F.col("_department").alias("department"),
        "title_passage",
        F.when(F.size("_packed") == 0, title_only).otherwise(F.col("_packed")).alias("passages"),
    )


def jd_passages(documents: DataFrame) -> DataFrame:
    return explode_rows(documents, ["jd_id"], "passages", "p", "passage_pos").select(
        "jd_id", "passage_pos", "p.section", "p.text"
    )


def jd_build_rejects(jd: DataFrame) -> DataFrame:
    reason = F.when(F.col("id").isNull(), "missing_id").when(X.is_blank(F.col("job_title")), "missing_job_title")
    return jd.select("id", reason.alias("reason")).where(F.col("reason").isNotNull())


def selected_passages(passages: Column, query_type: str, limit: int) -> Column:
    """Passages a query kind is scored against: by section preference, then position; all if none fits."""
    def of_section(section: str) -> Column:
        return F.filter(passages, lambda p: p["section"].startswith(section))

    chosen = F.concat(*[of_section(section) for section in SECTION_PRIORITY[query_type]])
    return F.slice(F.when(F.size(chosen) > 0, chosen).otherwise(passages), 1, limit)
