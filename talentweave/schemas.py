"""Spark types of the nested records."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = T.StringType()
_TEXTS = T.ArrayType(_TEXT)


def _struct(*names: str, **typed: T.DataType) -> T.StructType:
    fields = [T.StructField(n, _TEXT) for n in names] + [T.StructField(n, t) for n, t in typed.items()]
    return T.StructType(fields)


def _marked(kind: T.StructType, **marks: dict) -> T.StructType:
    """The type with what its fields must keep; see ``talentweave.functions.strict``."""
    return T.StructType([T.StructField(f.name, f.dataType, True, marks.get(f.name, f.metadata)) for f in kind.fields])


_MUST = {"must": True}

EVIDENCE = T.ArrayType(_marked(_struct(page_number=T.IntegerType(), source_text=_TEXT), source_text=_MUST))

BASIC_INFO = _struct(
    "name", "phone", "email", "location", "target_job_title", "personal_website", "github", other_links=_TEXTS
)
EDUCATION = _struct(
    "school", "degree", "major", "start_date_raw", "end_date_raw", description=_TEXTS, evidence=EVIDENCE
)
SKILL = _marked(_struct("skill", evidence=EVIDENCE), skill=_MUST)
WORK = _struct(
    "company", "job_title", "department", "start_date_raw", "end_date_raw",
    responsibilities=_TEXTS, achievements=_TEXTS, evidence=EVIDENCE,
)
PROJECT = _struct(
    "project_name", "start_date_raw", "end_date_raw", description=_TEXTS, responsibilities=_TEXTS,
    technologies=_TEXTS, achievements=_TEXTS, evidence=EVIDENCE,
)
DATED_NAME = _marked(_struct("name", "date_raw", evidence=EVIDENCE), name=_MUST)
LANGUAGE = _marked(_struct("language", "level", evidence=EVIDENCE), language=_MUST)

RESUME = T.StructType([
    T.StructField("schema_version", T.IntegerType(), True, {"filled": True}),
    T.StructField("basic_info", BASIC_INFO),
    T.StructField("education_background", _struct(educations=T.ArrayType(EDUCATION))),
    T.StructField("knowledge_and_experience", _struct(
        skills=T.ArrayType(SKILL), work_experiences=T.ArrayType(WORK), project_experiences=T.ArrayType(PROJECT),
    )),
    T.StructField("other_info", _struct(
        certificates=T.ArrayType(DATED_NAME), awards=T.ArrayType(DATED_NAME), languages=T.ArrayType(LANGUAGE),
        publications=_TEXTS, self_evaluation=_TEXTS, other=_TEXTS,
    )),
])

RESPONSIBILITY = _struct(sequence=T.IntegerType(), description=_TEXT, tasks=_TEXTS, time_percentage=_TEXT)

JD_COLUMNS = [
    "id", "job_title", "department", "responsibilities", "minimum_education", "education_background",
    "work_experience_raw", "competencies", "content_hash", "source_payload", "schema_version", "created_at",
    "updated_at",
]

# What reports may say.
STATUSES = ("matched", "partially_matched", "mismatched", "unknown", "not_applicable")
DIMENSIONS = ("education", "major", "experience", "skills", "responsibilities")

_TOLD, _SOME = {"must": True, "text": True}, {"must": True, "least": 1}
_SCORE = {"must": True, "null": True, "low": 0, "high": 100}
_ONE_DIMENSION = {"must": True, "one_of": list(DIMENSIONS)}

_CITATION = T.ArrayType(_marked(
    _struct("source", "path", "quote"), source={"must": True, "one_of": ["resume", "jd"]}, path=_TOLD, quote=_TOLD))
ASSESSMENT = _marked(
    _struct("status", score=T.DoubleType(), rationale=_TEXT, evidence=_CITATION, missing_information=_TEXTS),
    status={"must": True, "one_of": list(STATUSES)}, score=_SCORE, rationale=_TOLD, evidence=_MUST, missing_information=_TOLD)
FINDING = _marked(
    _struct("dimension", "description", evidence=_CITATION), dimension=_ONE_DIMENSION, description=_TOLD, evidence=_SOME)
QUESTION = _marked(
    _struct("dimension", "question", "purpose", evidence=_CITATION, evaluation_points=_TEXTS),
    dimension=_ONE_DIMENSION, question=_TOLD, purpose=_TOLD, evidence=_SOME, evaluation_points={**_SOME, "text": True})
REPORT = T.StructType([
    T.StructField("jd_id", T.LongType(), True, _MUST),
    T.StructField("target_ids", _TEXTS, True, {**_SOME, "text": True}),
    T.StructField("summary", _TEXT, True, _TOLD),
    T.StructField("overall_score", T.DoubleType(), True, _SCORE),
    T.StructField("overall_score_reason", _TEXT, True, _TOLD),
    T.StructField("dimensions", _marked(
        _struct(**{name: ASSESSMENT for name in DIMENSIONS}), **{name: _MUST for name in DIMENSIONS}), True, _MUST),
    T.StructField("strengths", T.ArrayType(FINDING), True, _MUST),
    T.StructField("gaps", T.ArrayType(FINDING), True, _MUST),
    T.StructField("interview_questions", T.ArrayType(QUESTION), True, _SOME),
])
