"""Strict checks of model output and extracted résumés, and report judging that never fails open."""

import json

import pytest
from pyspark.sql import functions as F

from talentweave.functions import strict
from talentweave.operators import assemble
from talentweave.plans import pipelines
from talentweave.schemas import REPORT, RESUME
from talentweave.sources import intake
from test_pipelines import jds, report, resumes


def errors(spark, texts, schema, closed):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select("i", strict.json_errors(F.col("t"), schema, closed).alias("e")).collect()
    return [sorted((e.path, e.message) for e in r.e) for r in sorted(found, key=lambda r: r.i)]


def changed(*path, to=..., base=None):
    """The valid report with one place replaced, or removed where nothing is given."""
    record = json.loads(base or report(1, ["target_1"]))
    at = record
    for step in path[:-1]:
        at = at[step]
    if to is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = to
    return json.dumps(record)


REPORTS = [
    (report(1, ["target_1"]), []),
    ("{}", [(f, "missing") for f in sorted(REPORT.names)]),
    (changed("zzz", to=1), [("zzz", "unknown_field")]),
    (changed("dimensions", "major", "evidence", 0, "page", to=1), [("dimensions.major.evidence[0].page", "unknown_field")]),
    (changed("dimensions", "skills", "status", to="superb"), [("dimensions.skills.status", "not_allowed")]),
    (changed("overall_score", to="90"), [("overall_score", "not_a_number")]),
    (changed("overall_score", to=101), [("overall_score", "out_of_range")]),
    (changed("overall_score", to=True), [("overall_score", "not_a_number")]),
    (changed("overall_score", to=None), []),
    (changed("overall_score"), [("overall_score", "missing")]),
    (changed("summary", to=" \n"), [("summary", "blank")]),
    (changed("summary", to=7), [("summary", "not_a_string")]),
    (changed("target_ids", to=[]), [("target_ids", "too_few")]),
    (changed("target_ids", to=["a", " ", 3, None]), [("target_ids[1]", "blank"), ("target_ids[2]", "not_a_string"), ("target_ids[3]", "not_a_string")]),
    (changed("interview_questions", to=[]), [("interview_questions", "too_few")]),
    (changed("interview_questions", 0, "evaluation_points", to=[]), [("interview_questions[0].evaluation_points", "too_few")]),
    (changed("strengths", to=None), [("strengths", "missing")]),
    (changed("strengths", 0, to="x"), [("strengths[0]", "not_an_object")]),
    (changed("jd_id", to=1.5), [("jd_id", "not_an_integer")]),
    (changed("jd_id", to="1"), [("jd_id", "not_an_integer")]),
    (changed("dimensions", to=[]), [("dimensions", "not_an_object")]),
    ("[]", [("$", "not_an_object")]), ("null", [("$", "not_an_object")]), ("{", [("$", "invalid_json")]), (None, []),
]


def test_reports(spark):
    got = errors(spark, [t for t, _ in REPORTS], REPORT, True)
    assert got == [sorted(e) for _, e in REPORTS]


RESUMES = [
    ("{}", []), ('{"other": 1, "basic_info": {"name": null, "unknown": 2}}', []),
    ('{"basic_info": {"name": 5, "phone": true, "email": {}, "other_links": [1, "a", null]}}',
     [("basic_info.name", "not_a_string"), ("basic_info.phone", "not_a_string"), ("basic_info.email", "not_a_string"),
      ("basic_info.other_links[0]", "not_a_string"), ("basic_info.other_links[2]", "not_a_string")]),
    ('{"schema_version": null, "basic_info": null, "education_background": {"educations": null}}',
     [("schema_version", "not_an_integer"), ("basic_info", "not_an_object"), ("education_background.educations", "not_a_list")]),
    ('{"knowledge_and_experience": {"skills": [{"skill": "a"}, {}], "work_experiences": [{"company": 5, "evidence": [{"page_number": "1"}]}]}}',
     [("knowledge_and_experience.skills[1].skill", "missing"), ("knowledge_and_experience.work_experiences[0].company", "not_a_string"),
      ("knowledge_and_experience.work_experiences[0].evidence[0].page_number", "not_an_integer"),
      ("knowledge_and_experience.work_experiences[0].evidence[0].source_text", "missing")]),
    ('{"other_info": {"awards": [{"name": null}], "publications": ["a", 1]}}',
     [("other_info.awards[0].name", "missing"), ("other_info.publications[1]", "not_a_string")]),
]


def test_resumes(spark):
    assert errors(spark, [t for t, _ in RESUMES], RESUME, False) == [sorted(e) for _, e in RESUMES]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(RESUMES)], "document_hash int, output_text string")
    got = {r.document_hash: r for r in intake.ingest_json(rows, "output_text").collect()}
    assert [got[i].ingest_status for i in range(len(RESUMES))] == ["ok" if not e else "invalid_schema" for _, e in RESUMES]
    quality = {r.resume_id: r for r in pipelines.judge_resumes(intake.ingest_json(rows, "output_text")).collect()}
    assert [quality[i].issue_count for i in (2, 3, 4, 5)] == [5, 3, 4, 2] and not quality[2].can_analyze


@pytest.mark.parametrize("content", ["{}", '{"jd_id": 1}', '{"jd_id": 1, "summary": 7, "zzz": 1}', changed("zzz", to=1),
                                     changed("dimensions", "skills", "status", to="superb"), changed("overall_score", to="90"),
                                     changed("gaps"), changed("overall_score", to=101), "[]", "null"])
def test_judging_does_not_fail_open(spark, content):
    jd = jds(spark)
    people = resumes(spark, (1, "data engineer", "engineer", "build spark pipelines", "spark"))
    bindings = spark.createDataFrame([(1, "target_1", 1, "data engineer", 1, "exact", "complete", False)],
        "resume_id long, target_id string, target_pos int, requested_job_title string, selected_jd_id long, source string, analysis_scope string, human_confirmed boolean")
    inputs = assemble.analysis_inputs(bindings, assemble.jd_clean(jd), people)
    stored = spark.createDataFrame([(1, 1, 1, content), (1, 1, 2, report(1, ["target_1"]))], "resume_id long, jd_id long, event_id long, content string").selectExpr(
        "*", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "1 AS n_choices", "CAST(NULL AS STRING) AS refusal", "'stop' AS finish_reason", "false AS has_tool_calls")
    got = {r.event_id: r for r in pipelines.judge_responses(stored, inputs).collect()}
    assert (got[1].succeeded, got[1].code, got[1].stage) == (False, "invalid_schema", "output_validate")
    assert got[2].succeeded
