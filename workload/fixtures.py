"""Fixture views over the given tables, as SQL that Spark and DuckDB both run.

``SHA(x)`` is the only spelling that differs per engine. Every view covers its whole base tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.schemas import RESPONSIBILITY, RESUME

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
N_PART = "(SELECT count(*) FROM part)"

VIEWS = {
    "fx_jd": f"""
SELECT p_partkey AS id, concat(p_name, ' ', p_size) AS job_title,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS department,
  p_type AS minimum_education,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('field ', p_size % 5) END AS education_background,
  CASE WHEN p_partkey % 4 = 0 THEN '  ' ELSE concat(p_size % 10, ' years') END AS work_experience_raw,
  concat(p_name, ' ', p_type) AS duty_1, concat('support ', p_brand) AS duty_2, p_type AS skill_1, p_name AS skill_2,
  SHA(p_name) AS content_hash, p_brand AS source_payload, 'v1' AS schema_version,
  CAST('2024-01-01' AS DATE) + p_size AS created_at, CAST('2024-06-01' AS DATE) + p_size AS updated_at
FROM part""",
    "fx_alias": """
SELECT concat('senior ', job_title) AS alias_title, min(job_title) AS standard_title
FROM fx_jd GROUP BY concat('senior ', job_title)""",
    "fx_alias_twice": """
SELECT alias_title, standard_title FROM fx_alias UNION ALL SELECT alias_title, standard_title FROM fx_alias
UNION ALL SELECT alias_title, (SELECT max(job_title) FROM fx_jd) AS standard_title FROM fx_alias""",
    "fx_base": f"""
SELECT o.o_orderkey AS resume_id, o.o_custkey, o.o_orderpriority, o.o_orderstatus, o.o_orderdate,
  a.job_title AS a_title, a.department AS a_department, a.duty_1 AS a_duty_1, a.duty_2 AS a_duty_2,
  a.skill_1 AS a_skill_1, a.skill_2 AS a_skill_2,
  b.job_title AS b_title, b.duty_1 AS b_duty_1, b.duty_2 AS b_duty_2, b.skill_1 AS b_skill_1,
  CASE o.o_orderkey % 8
    WHEN 0 THEN concat(a.job_title, '、', b.job_title) WHEN 1 THEN concat(' ', a.job_title, ' ，', b.job_title, '、')
    WHEN 2 THEN concat(a.job_title, ';', a.job_title)   WHEN 3 THEN concat('senior ', a.job_title)
    WHEN 4 THEN concat(a.job_title, '工程师/', b.job_title, '经理')
    WHEN 5 THEN concat('unknown ', o.o_orderkey)         WHEN 6 THEN NULL
    ELSE concat('　', a.job_title, '　') END AS target_job_title
FROM orders o
JOIN fx_jd a ON a.id = o.o_orderkey % {N_PART}
JOIN fx_jd b ON b.id = o.o_custkey % {N_PART}""",
    "fx_intents": "SELECT resume_id, target_job_title FROM fx_base",
    "fx_people": """
SELECT x.*, c.c_name, c.c_mktsegment, n.n_name,
  CASE WHEN resume_id % 17 = 0 THEN NULL ELSE c.c_name END AS name,
  CASE WHEN resume_id % 5 = 0 THEN NULL ELSE concat('1', c.c_custkey) END AS phone,
  CASE WHEN resume_id % 3 = 0 THEN NULL ELSE concat('u', c.c_custkey, '@example.com') END AS email,
  resume_id % 10 <> 0 AS has_education, resume_id % 5 <> 0 AS has_skills,
  resume_id % 3 AS n_work, resume_id % 2 AS n_project, resume_id % 14 = 1 AS empty_project,
  CASE WHEN resume_id % 6 = 0 THEN NULL ELSE n.n_name END AS school,
  CASE WHEN resume_id % 4 = 0 THEN '' ELSE c.c_mktsegment END AS degree,
  CAST(CAST(x.o_orderdate AS DATE) AS STRING) AS start_date_raw,
  CASE WHEN x.o_orderstatus = 'P' THEN NULL ELSE x.o_orderstatus END AS end_date_raw,
  CASE WHEN resume_id % 4 = 0 THEN NULL ELSE x.b_title END AS work_2_title
FROM fx_base x JOIN customer c ON c.c_custkey = x.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "fx_chunks": """
SELECT vec_id AS chunk_id,
  CASE WHEN vec_id % 29 = 0 THEN 1000000000 + vec_id ELSE CAST(floor(vec_id / 12.0) AS BIGINT) END AS jd_id,
  concat('chunk ', vec_id) AS content,
  CASE label % 3 WHEN 0 THEN 'responsibility' WHEN 1 THEN 'qualification' ELSE 'competency' END AS chunk_type,
  vec_id % 11 <> 0 AS is_embedding_target,
  CASE WHEN vec_id % 13 = 0 THEN NULL ELSE embedding END AS embedding
FROM embeddings""",
    "fx_queries": f"""
SELECT q.resume_id, 'target_1' AS target_id, concat(t.job_title, ' lead') AS requested_job_title, q.query_id,
  q.query_type, q.query_order, q.weight, q.embedding,
  CASE WHEN q.query_type = 'target_job_title' THEN NULL ELSE concat(j.duty_1, ' ', j.minimum_education) END
    AS resume_evidence_text
FROM (
  SELECT CAST(floor(vec_id / 5.0) AS BIGINT) AS resume_id, concat('q', vec_id) AS query_id, vec_id,
    CASE WHEN vec_id % 5 = 0 THEN 'target_job_title'
      ELSE CASE CAST(floor(vec_id / 5.0) AS BIGINT) % 4
        WHEN 0 THEN CASE vec_id % 5 WHEN 3 THEN 'project_experience' WHEN 4 THEN 'skills' ELSE 'work_experience' END
        WHEN 1 THEN 'work_experience'
        WHEN 2 THEN CASE WHEN vec_id % 5 <= 2 THEN 'project_experience' ELSE 'skills' END
        ELSE CASE vec_id % 5 WHEN 1 THEN 'work_experience' WHEN 4 THEN 'skills' ELSE 'project_experience' END END END
      AS query_type,
    CAST(vec_id % 5 AS INT) AS query_order, 1 + CAST(vec_id % 100 AS DOUBLE) / 100 AS weight, embedding
  FROM embeddings) q
JOIN fx_jd t ON t.id = q.resume_id * 3 % {N_PART}
JOIN fx_jd j ON j.id = q.vec_id * 7 % {N_PART}""",
    "fx_decisions": f"""
SELECT event_id, ts, user_id AS resume_id,
  CASE WHEN event_id % 31 = 0 THEN '  ' ELSE concat('target_', event_id % 2 + 1) END AS target_id,
  CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 'confirm' ELSE 'reject' END AS action,
  CASE WHEN event_id % 2 = 0 THEN user_id % {N_PART} ELSE event_id % 200 END AS jd_id,
  CASE WHEN event_type = 'error' THEN '  ' ELSE event_type END AS reason
FROM events""",
    "fx_attempts": """
SELECT CAST(floor(event_id / 5.0) AS BIGINT) AS resume_id, event_id % 2 AS jd_id, event_id, ts,
  event_type = 'purchase' AS succeeded, event_type <> 'signup' AS retryable
FROM events""",
    "fx_reports": """
SELECT doc_id AS report_id, CAST(floor(doc_id / 3.0) AS BIGINT) AS resume_id, doc_id % 4 AS jd_id, n_chars,
  CASE WHEN doc_id % 12 = 0 THEN 'partial' ELSE 'complete' END AS analysis_scope,
  CASE WHEN doc_id % 19 = 0 THEN 0 ELSE doc_id % 3 + 1 END AS n_questions,
  concat('target_', doc_id % 3 + 1) AS target_a,
  CASE WHEN doc_id % 13 = 0 THEN concat('target_', doc_id % 3 + 1) ELSE concat('target_', doc_id % 5 + 4) END AS target_b
FROM documents""",
    "fx_bindings": """
SELECT l_orderkey AS resume_id, concat('target_', l_linenumber) AS target_id,
  CASE WHEN (l_orderkey + l_linenumber) % 9 = 0 THEN NULL ELSE l_partkey END AS expected_jd_id,
  CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN NULL WHEN l_suppkey % 10 = 0 THEN l_suppkey ELSE l_partkey END
    AS actual_jd_id
FROM lineitem""",
    "fx_quotes": """
SELECT doc_id, CASE WHEN doc_id % 41 = 0 THEN 'other' ELSE 'resume' END AS source,
  CASE doc_id % 7 WHEN 0 THEN '/markdown/0' WHEN 1 THEN 'markdown' WHEN 2 THEN '/mark~2down' WHEN 3 THEN '/lines/0'
    WHEN 4 THEN '/lines/00' ELSE '/markdown' END AS path,
  CASE WHEN doc_id % 9 = 0 THEN concat(substring(text, 5, 20), '#no#')
    ELSE substring(text, CAST(1 + doc_id % 50 AS INT), 20) END AS quote
FROM documents""",
    "fx_raw_json": """
SELECT event_id, CASE event_id % 9 WHEN 0 THEN concat('```json', chr(10), props, chr(10), '```')
  WHEN 1 THEN concat('```', props, '```') WHEN 2 THEN '   ' WHEN 3 THEN substring(props, 1, length(props) - 1)
  WHEN 4 THEN concat('{"k": "', event_type, '"}') WHEN 5 THEN concat('[', props, ']')
  WHEN 6 THEN concat(props, '}') WHEN 7 THEN concat(props, '] x') ELSE props END AS output_text
FROM events""",
    "fx_responses": """
SELECT event_id, CASE event_id % 11 WHEN 0 THEN 0 ELSE 1 END AS n_choices,
  CASE event_id % 13 WHEN 1 THEN 'no' ELSE NULL END AS refusal,
  CASE event_type WHEN 'click' THEN 'length' WHEN 'signup' THEN 'content_filter' WHEN 'error' THEN NULL ELSE 'stop' END
    AS finish_reason,
  event_id % 17 = 3 AS has_tool_calls,
  CASE event_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN substring(props, 1, length(props) - 1)
    WHEN 2 THEN concat('{"k": "', event_type, '"}') ELSE props END AS content,
  CASE event_id % 6 WHEN 0 THEN 408 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 404 WHEN 4 THEN 409 ELSE 200 END AS http_status,
  CASE event_id % 6 WHEN 0 THEN 'soon' WHEN 1 THEN '-3' WHEN 2 THEN ' 12.5 ' WHEN 3 THEN 'Infinity' WHEN 4 THEN NULL
    ELSE concat(event_id % 90, '') END AS retry_header,
  CAST(event_id % 4 AS INT) AS retry_count
FROM events""",
    "fx_json_docs": """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN concat('[', props, ', "text of ', event_type, '", ["a b", {"c/d": "e~f"}], null]')
  WHEN 2 THEN concat('{"01": "zero", "x": {"~y": ["p", "', event_type, '"]}, "": "none", "l": {"0": "object", "it''s": "q"}}') WHEN 3 THEN '"just text"'
  WHEN 4 THEN concat('[', props) WHEN 5 THEN concat('{"m": [[{"z": "  "}, "', event_type, '"], 1, null, true], "x": "', event_type, '"}')
  ELSE concat('{"m": {"0": {"0": {"z": "deep ', event_type, '"}}}, "l": ["', event_type, '"]}') END AS doc,
  CASE CAST(floor(event_id / 7.0) AS BIGINT) % 18 WHEN 0 THEN '/1' WHEN 1 THEN '/2/0' WHEN 2 THEN '/2/1/c~1d' WHEN 3 THEN '/x/~0y/1' WHEN 4 THEN '/01' WHEN 5 THEN '/'
  WHEN 6 THEN '/l/0' WHEN 7 THEN '/m/0/0/z' WHEN 8 THEN '/m/0/1' WHEN 9 THEN '/x' WHEN 10 THEN 'x' WHEN 11 THEN '/x/~2' WHEN 12 THEN '/l/it''s' WHEN 13 THEN '/l/00'
  WHEN 14 THEN '/k' WHEN 15 THEN '/m/1' WHEN 16 THEN '' ELSE '/2/99999999999' END AS path,
  CASE event_id % 5 WHEN 0 THEN 'e' WHEN 1 THEN event_type WHEN 2 THEN ' ' ELSE 'text' END AS quote
FROM events""",
    "fx_report_json": """
SELECT doc_id AS event_id, CASE doc_id % 14 WHEN 1 THEN '{}' WHEN 2 THEN replace(j, '"summary"', '"zzz": 1, "summary"')
  WHEN 3 THEN replace(j, '"status": "matched"', '"status": "superb"') WHEN 4 THEN replace(j, '"overall_score": 85', '"overall_score": "85"')
  WHEN 5 THEN replace(j, '"overall_score": 85', '"overall_score": 101') WHEN 6 THEN replace(j, '"evaluation_points": ["point"]', '"evaluation_points": []')
  WHEN 7 THEN replace(j, '"summary": "fits', '"summary": " ", "_": "') WHEN 8 THEN replace(j, '"jd_id": ', '"jd_id": 0.') WHEN 9 THEN replace(j, '"gaps": [], ', '')
  WHEN 10 THEN replace(j, '"gaps": []', '"gaps": null') WHEN 11 THEN replace(j, '"quote"', '"page": 3, "quote"') WHEN 12 THEN concat('[', j, ']')
  WHEN 13 THEN '{"jd_id": 1, "summary": 7, "zzz": 1}' ELSE j END AS content
FROM (SELECT doc_id, concat('{"jd_id": ', 1 + doc_id, ', "target_ids": ["target_1"], "summary": "fits ', source, '", "overall_score": 85, "overall_score_reason": "even", ',
  '"dimensions": {"education": ', a, ', "major": ', a, ', "experience": ', a, ', "skills": ', a, ', "responsibilities": ', a, '}, "strengths": [], "gaps": [], ',
  '"interview_questions": [{"dimension": "skills", "question": "why ', lang, '", "purpose": "depth", "evidence": [', e, '], "evaluation_points": ["point"]}]}') AS j
FROM (SELECT doc_id, source, lang, e, concat('{"status": "matched", "score": 85, "rationale": "', lang, '", "evidence": [', e, '], "missing_information": []}') AS a
FROM (SELECT doc_id, source, lang, concat('{"source": "resume", "path": "/skills/0", "quote": "', lang, '"}, {"source": "jd", "path": "/job_title", "quote": "', source, '"}') AS e
FROM documents)))""",
    "fx_resume_json": """
SELECT doc_id, text, CASE doc_id % 12 WHEN 1 THEN replace(j, '"phone": "1"', '"phone": null') WHEN 2 THEN replace(j, '"name": "', '"name": 5, "_": "')
  WHEN 3 THEN replace(j, '"skill": "a"', '"level": "a"') WHEN 4 THEN replace(j, '"company": "c"', '"company": 5') WHEN 5 THEN replace(j, '"source_text"', '"text"')
  WHEN 6 THEN replace(j, '"other_links": []', '"other_links": [1, 2]') WHEN 7 THEN replace(j, '"page_number": 1', '"page_number": "1"')
  WHEN 8 THEN substring(j, 1, length(j) - 1) WHEN 9 THEN concat('```json', chr(10), j, chr(10), '```') WHEN 10 THEN ' ' WHEN 11 THEN replace(j, '"schema_version": 1', '"schema_version": null')
  ELSE j END AS output_text
FROM (SELECT doc_id, text, concat('{"schema_version": 1, "more": 2, "basic_info": {"name": "', source, '", "phone": "1", "target_job_title": "', lang, '", "other_links": []}, ',
  '"education_background": {"educations": [{"school": "s", "degree": "d", "evidence": [{"page_number": 1, "source_text": "x"}]}]}, ',
  '"knowledge_and_experience": {"skills": [{"skill": "a"}], "work_experiences": [{"company": "c", "job_title": "j", "start_date_raw": "1", "end_date_raw": "2"}]}}') AS j
FROM documents)""",
    "fx_doc_jd": """
SELECT CASE WHEN doc_id % 37 = 0 THEN NULL ELSE doc_id END AS id, text,
  CASE WHEN doc_id % 23 = 0 THEN '  ' ELSE concat(source, '　 ', lang) END AS job_title,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS department,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('level ', doc_id % 4) END AS minimum_education,
  CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE source END AS education_background,
  CASE WHEN doc_id % 9 = 0 THEN NULL ELSE concat(doc_id % 12, '  years') END AS work_experience_raw,
  CASE WHEN doc_id % 6 = 0 THEN NULL ELSE concat('handle ', source) END AS description,
  doc_id % 29 <> 0 AS has_lines
FROM documents""",
}


def _duckdb(sql: str) -> str:
    return re.sub(r"\bSHA\(", "sha256(", sql)


def _spark(sql: str) -> str:
    return re.sub(r"\bSHA\((\w+)\)", r"sha2(\1, 256)", sql)


def _needed(text: str, known: dict[str, str]) -> list[str]:
    """Names of ``known`` that a text uses, dependencies first."""
    order: list[str] = []

    def visit(body: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b{name}\b", body):
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(text)
    return order


def with_clause(text: str, known: dict[str, str]) -> str:
    """``text`` preceded by the WITH list of everything it uses."""
    parts = ",\n".join(f"{n} AS (\n{known[n].strip()}\n)" for n in _needed(text, known))
    return f"WITH {parts}\n{text.strip()}" if parts else text.strip()


def duckdb_sql(text: str, extra: dict[str, str] | None = None) -> str:
    return _duckdb(with_clause(text, {**VIEWS, **(extra or {})}))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a Spark DataFrame.

    The number of parts stands in it as a number: where a side whose join key has a subquery is broadcast, Spark builds the keys before the
    subquery has ended, and fails.
    """
    text = _spark(with_clause(f"SELECT * FROM {name}", VIEWS))
    if N_PART in text:
        text = text.replace(N_PART, f"{table(spark, sf_dir, 'part').count()}L")
    used = [t for t in BASE if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
    text = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


# ---- nested records, built per row from the flat views --------------------------------------------


def jd_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    duty = F.struct(
        F.lit(1).alias("sequence"), F.col("duty_1").alias("description"),
        F.array("duty_2", F.lit(" "), "duty_2").alias("tasks"), F.lit("50").alias("time_percentage"),
    )
    return view(spark, sf_dir, "fx_jd").withColumn("responsibilities", F.array(duty)).withColumn(
        "competencies", F.array("skill_1", "skill_2", "skill_1")
    )


def doc_jd_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JD per document, its whole text as task and competency lines."""
    lines = F.split("text", "\n")
    sentences = F.split("text", r"\. ")
    duties = F.array(
        F.struct(F.lit(1).alias("sequence"), F.col("description"), lines.alias("tasks"), F.lit("60").alias("time_percentage")),
        F.struct(F.lit(2).alias("sequence"), F.lit(None).cast("string").alias("description"),
                 F.array().cast("array<string>").alias("tasks"), F.lit(None).cast("string").alias("time_percentage")),
        F.struct(F.lit(3).alias("sequence"), F.lit("report  results").alias("description"),
                 F.array("education_background").alias("tasks"), F.lit(None).cast("string").alias("time_percentage")),
    )
    kind = f"array<{RESPONSIBILITY.simpleString()}>"
    return (
        view(spark, sf_dir, "fx_doc_jd")
        .withColumn("responsibilities", F.when(F.col("has_lines"), duties.cast(kind)))
        .withColumn("competencies", F.when(F.col("has_lines"), sentences))
    )


def resume_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col
    no_text, texts = F.lit(None).cast("string"), lambda *c: F.array(*c).cast("array<string>")

    def proof(c):
        return F.array(F.struct(F.lit(1).alias("page_number"), c.alias("source_text")))

    fields = {f.name: f.dataType for f in RESUME.fields}
    know = {f.name: f.dataType for f in fields["knowledge_and_experience"].fields}
    none = F.array()
    education = F.struct(
        p("school"), p("degree"), F.lit("major").alias("major"), p("start_date_raw"), p("end_date_raw"),
        texts(F.lit(" top "), F.lit("")).alias("description"),
        F.when(p("resume_id") % 3 == 0, F.array().cast("array<struct<page_number:int,source_text:string>>"))
        .otherwise(proof(p("n_name"))).alias("evidence"),
    )
    work_1 = F.struct(
        p("c_mktsegment").alias("company"), p("o_orderpriority").alias("job_title"), p("a_department").alias("department"),
        p("start_date_raw"), p("end_date_raw"),
        texts(p("a_duty_1"), F.lit("  "), F.concat(F.lit(" "), p("a_duty_2"), F.lit(" ")), p("a_duty_1")).alias("responsibilities"),
        F.when(p("resume_id") % 2 == 0, texts(F.concat(F.lit("handled  "), p("b_title")))).otherwise(texts()).alias("achievements"),
        proof(p("a_duty_1")).alias("evidence"),
    )
    work_2 = F.struct(
        no_text.alias("company"), p("work_2_title").alias("job_title"),
        F.concat(F.lit("　"), p("c_mktsegment")).alias("department"), p("start_date_raw"), p("end_date_raw"),
        texts(p("b_duty_1")).alias("responsibilities"), texts().alias("achievements"), proof(p("b_duty_1")).alias("evidence"),
    )
    project = F.struct(
        F.when(~p("empty_project"), F.concat(p("a_skill_2"), F.lit(" rollout"))).alias("project_name"),
        p("start_date_raw"), p("end_date_raw"),
        *[F.when(~p("empty_project"), v).otherwise(texts()).alias(n) for n, v in {
            "description": texts(p("b_duty_2")), "responsibilities": texts(p("a_duty_1")),
            "technologies": texts(p("a_skill_1"), p("b_skill_1"), p("a_skill_1")), "achievements": texts(),
        }.items()],
        proof(p("b_duty_2")).alias("evidence"),
    )
    skills = [F.struct(s.alias("skill"), proof(s).alias("evidence")) for s in (
        p("a_skill_1"), F.concat(F.lit(" "), p("a_skill_2"), F.lit("  ")), p("b_skill_1"), p("a_skill_1")
    )]
    other = F.struct(
        F.array(F.struct(F.lit(" cert ").alias("name"), no_text.alias("date_raw"), proof(F.lit("c")).alias("evidence"))).alias("certificates"),
        none.alias("awards"),
        F.array(F.struct(p("n_name").alias("language"), F.lit(" ").alias("level"), proof(F.lit("l")).alias("evidence"))).alias("languages"),
        none.alias("publications"), none.alias("self_evaluation"), texts(p("c_name"), p("c_name")).alias("other"),
    )
    return view(spark, sf_dir, "fx_people").select(
        "resume_id", F.lit(1).alias("schema_version"),
        F.struct(
            p("name"), p("phone"), p("email"), p("n_name").alias("location"), p("target_job_title"),
            no_text.alias("personal_website"), no_text.alias("github"), none.alias("other_links"),
        ).cast(fields["basic_info"]).alias("basic_info"),
        F.struct(F.when(p("has_education"), F.array(education)).otherwise(none).alias("educations"))
        .cast(fields["education_background"]).alias("education_background"),
        F.struct(
            F.when(p("has_skills"), F.array(*skills)).otherwise(none).cast(know["skills"]).alias("skills"),
            F.when(p("n_work") == 2, F.array(work_1, work_2)).when(p("n_work") == 1, F.array(work_1)).otherwise(none)
            .cast(know["work_experiences"]).alias("work_experiences"),
            F.when(p("n_project") == 1, F.array(project)).otherwise(none).cast(know["project_experiences"])
            .alias("project_experiences"),
        ).alias("knowledge_and_experience"),
        other.cast(fields["other_info"]).alias("other_info"),
    )
