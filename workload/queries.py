"""Registered queries: the Spark form and, next to it, the reference SQL over the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.config import DIMENSION_WEIGHTS, PROJECT, SKILLS, TITLE, WORK, RecallConfig, RerankConfig
from talentweave.functions import strict
from talentweave.functions import text as X
from talentweave.functions import vectors as V
from talentweave.functions.scorers import JaccardScorer, ModelScorer
from talentweave.operators import (
    assemble, exact, intents, passages, quality, query_units, recall, reports, rerank, runs, similarity, state,
)
from talentweave.plans import pipelines
from talentweave.plans.storage import materialize, shared_folder
from talentweave.schemas import BASIC_INFO, REPORT
from talentweave.sources import intake, responses, tables
from talentweave.sources.store import ResultStore
from workload import fixtures as fx
from workload import reference_sql as R

DIM = 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    def register(build: Callable[["Work"], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Work(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = fx.duckdb_sql(sql, {**R.TABLES, **(extra or {})})
        return build

    return register


def r6(name: str | Column) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    c = F.col(name) if isinstance(name, str) else name
    out = F.round(c, 6) + F.lit(0.0)
    return out.alias(name) if isinstance(name, str) else out


def joined(name: str, sep: str = "|") -> Column:
    return F.array_join(F.col(name).cast("array<string>"), sep).alias(name)


class Work:
    """Fixture views and the operator chains built on them, for one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def view(self, name: str) -> DataFrame:
        return fx.view(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return fx.table(self.spark, self.sf_dir, name)

    jd = cached_property(lambda self: fx.jd_rows(self.spark, self.sf_dir))
    doc_jd = cached_property(lambda self: fx.doc_jd_rows(self.spark, self.sf_dir))
    alias = cached_property(lambda self: self.view("fx_alias"))
    chunks = cached_property(lambda self: self.view("fx_chunks"))
    vectors = cached_property(lambda self: self.view("fx_queries"))
    resumes = cached_property(lambda self: fx.resume_rows(self.spark, self.sf_dir))
    intents = cached_property(lambda self: intents.normalize_intents(self.view("fx_intents")))
    targets = cached_property(lambda self: intents.explode_targets(self.intents))
    matches = cached_property(lambda self: exact.exact_match(self.targets, self.jd, self.alias))
    open_targets = cached_property(lambda self: exact.unresolved(self.matches).select(
        "resume_id", "target_id", "target_pos", "requested_job_title"))
    exact_candidates = cached_property(lambda self: exact.exact_candidates(self.matches, self.jd))
    state = cached_property(lambda self: state.exact_state(self.matches))

    def hits(self, **options) -> DataFrame:
        return similarity.nearest_chunks(self.vectors, self.chunks, top_k=30, dim=DIM, **options)

    weighted = cached_property(lambda self: recall.with_effective_weights(self.vectors.drop("embedding")))
    best = cached_property(lambda self: recall.best_chunk_per_query(self.hits()))
    evidence = cached_property(lambda self: recall.query_evidence(self.best, self.weighted))
    candidates = cached_property(lambda self: recall.recall_candidates(self.evidence))
    candidate_lists = cached_property(lambda self: recall.recall_candidates(
        recall.query_evidence(recall.best_chunk_per_query(self.hits(as_lists=True)), self.weighted)))
    titles = cached_property(lambda self: self.vectors.where(F.col("query_type") == TITLE).select(
        "resume_id", "target_id", "requested_job_title"))
    recalled = cached_property(lambda self: materialize(recall.ranked_candidates(self.candidate_lists, 10).join(
        self.titles, ["resume_id", "target_id"]), "recalled"))
    documents = cached_property(lambda self: materialize(
        passages.jd_documents(rerank.recalled_jds(self.jd, self.recalled)), "jd-documents"))
    # What review needs several times over.
    kept_matches = cached_property(lambda self: materialize(self.matches, "matches"))
    kept_state = cached_property(lambda self: state.exact_state(self.kept_matches))
    title_pairs = cached_property(lambda self: rerank.title_pairs(self.recalled, self.documents).select(
        "resume_id", "target_id", "jd_id", "left_text", "right_text"))
    support_pairs = cached_property(lambda self: rerank.support_pairs(self.recalled, self.vectors, self.documents))
    scored = cached_property(lambda self: rerank.score_pairs(rerank.support_pairs(
        self.recalled, self.vectors, self.documents, scorer=JaccardScorer())))
    best_passages = cached_property(lambda self: rerank.best_passages(self.scored))
    type_scores = cached_property(lambda self: rerank.support_type_scores(rerank.best_scores(self.scored)))
    rerank_candidates = cached_property(lambda self: rerank.rerank_candidates(
        rerank.title_scores(self.recalled, self.documents), self.type_scores))

    @cached_property
    def judged(self) -> DataFrame:
        events = self.view("fx_decisions")
        return state.judged_decisions(self.kept_state, exact.listed_candidates(events, self.kept_matches, self.jd), events)

    def embed(self, units: DataFrame) -> DataFrame:
        """Stand-in for a model: a stored vector per unit."""
        stored = self.table("embeddings")
        n = self.spark.read.parquet(f"{self.sf_dir}/embeddings.parquet").count()
        pos = F.regexp_extract("target_id", r"(\d+)", 1).cast("int")
        key = F.pmod(F.col("resume_id") * 7 + pos * 3 + F.col("query_order"), F.lit(n))
        return units.withColumn("_v", key).join(
            stored.select(F.col("vec_id").alias("_v"), "embedding"), "_v"
        ).drop("_v")

    def after_review(self, action: str | None = None) -> DataFrame:
        judged = self.judged if action is None else self.judged.where(F.col("action") == action)
        return state.apply_decisions(self.kept_state, state.winning_decisions(judged))

    def rejected_ids(self, action: str | None = None) -> DataFrame:
        """Rejected JDs of each target as text, for display."""
        judged = self.judged if action is None else self.judged.where(F.col("action") == action)
        winners = materialize(state.winning_decisions(judged), "winners")
        rejected = winners.where("action = 'reject'").select("resume_id", "target_id")
        candidates = exact.exact_candidates(self.kept_matches.join(rejected, ["resume_id", "target_id"], "left_semi"), self.jd)
        return state.rejected_candidates(candidates, winners).groupBy("resume_id", "target_id").agg(
            F.array_join(F.array_sort(F.collect_list("jd_id")).cast("array<string>"), ",").alias("rejected_jd_ids"))

    @cached_property
    def bindings(self) -> DataFrame:
        return state.target_bindings(materialize(self.after_review(), "reviewed"))

    @cached_property
    def inputs(self) -> DataFrame:
        return assemble.analysis_inputs(self.bindings, assemble.jd_clean(self.jd), self.resumes)

    @cached_property
    def assessments(self) -> DataFrame:
        n, k = F.col("n_chars"), F.col("dim")
        base = self.table("documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("dim"))
        d = F.col("doc_id")
        unknown, na = (n + 7 * k) % 23 == 0, (n + k) % 11 == 0
        status = (
            F.when(unknown, "unknown").when(na, "not_applicable").when((n + k) % 3 == 0, "matched")
            .when((n + k) % 3 == 1, "partially_matched").otherwise("mismatched")
        )
        score = (
            F.when(d % 21 == 0, F.when(k == 0, 50)).when(unknown | na, None).when((n + k) % 3 == 0, 80 + d % 25)
            .when((n + k) % 3 == 1, 40 + d % 40).otherwise(d % 40)
        )

        def cite(*names: str) -> Column:
            return F.array(*[F.struct(F.lit(s).alias("source"), F.lit("/x").alias("path"), F.lit("q").alias("quote")) for s in names])

        evidence = F.when((d + k) % 8 == 0, cite("resume")).when(
            (d + k) % 10 == 0, F.slice(cite("resume"), 1, 0)).otherwise(cite("jd", "resume", "jd"))
        names = F.array(*[F.lit(x) for x in ("education", "major", "experience", "skills", "responsibilities")])
        return base.select(
            d.alias("report_id"), "dim", F.get(names, F.col("dim")).alias("dimension"), status.alias("status"),
            score.cast("double").alias("score"), evidence.alias("evidence"),
            F.when((d + k) % 2 == 1, F.array(F.lit("m"))).otherwise(F.array().cast("array<string>")).alias("missing_information"),
        )

    @cached_property
    def overall(self) -> DataFrame:
        w = F.col("weighted_score")
        c = F.coalesce(w, F.lit(50.0))
        tenth = lambda x: F.floor(x * 10 + 0.5) / 10
        kind = F.col("report_id") % 6
        return reports.weighted_scores(self.assessments).withColumn(
            "overall_score",
            F.when(kind == 0, None).when(kind == 1, tenth(c) + 0.5).when(kind == 2, F.floor(c) + 0.25)
            .otherwise(tenth(w)).cast("double"),
        )

    attempts = cached_property(lambda self: self.view("fx_attempts"))
    folded = cached_property(lambda self: runs.attempt_fold(self.attempts))
    job_states = cached_property(lambda self: runs.job_states(
        self.attempts.select("resume_id", "jd_id").distinct().withColumn("first_pos", F.col("jd_id")), self.folded))


# ---- sources --------------------------------------------------------------------------------------


@query("jd_scan", "SELECT id, job_title, department, minimum_education, education_background, work_experience_raw, content_hash, source_payload, schema_version, created_at::VARCHAR AS created_at, updated_at::VARCHAR AS updated_at, 1 AS n_duties, 3 AS n_competencies FROM fx_jd")
def _(w):
    return tables.jd_scan(w.jd).select(
        *[c for c in w.jd.columns if c in (
            "id", "job_title", "department", "minimum_education", "education_background", "work_experience_raw",
            "content_hash", "source_payload", "schema_version")],
        F.col("created_at").cast("string").alias("created_at"), F.col("updated_at").cast("string").alias("updated_at"),
        F.size("responsibilities").alias("n_duties"), F.size("competencies").alias("n_competencies"),
    )


@query("chunk_scan", "SELECT chunk_id, jd_id, chunk_type FROM fx_chunks WHERE is_embedding_target AND embedding IS NOT NULL")
def _(w):
    return tables.chunk_scan(w.chunks).select("chunk_id", "jd_id", "chunk_type")


@query("content_hash", "SELECT doc_id, sha256(text) AS document_hash FROM documents")
def _(w):
    return intake.with_hash(w.table("documents"), "text").select("doc_id", "document_hash")


_PROCESSED = "(SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"


def _processed(w) -> DataFrame:
    """The run before this one: it saw the labelled documents."""
    labelled = w.table("documents").join(w.table("labels"), "doc_id", "left_semi")
    return intake.with_hash(labelled, "text").select("document_hash")


@query("incremental_new_docs", f"SELECT min(doc_id) AS doc_id, sha256(text) AS document_hash FROM documents WHERE sha256(text) NOT IN {_PROCESSED} GROUP BY sha256(text)")
def _(w):
    return intake.new_documents(intake.with_hash(w.table("documents"), "text"), _processed(w), "doc_id").select(
        "doc_id", "document_hash")


@query("incremental_from_cache", f"SELECT min(doc_id) AS doc_id, sha256(text) AS document_hash, bool_or(sha256(text) IN {_PROCESSED}) AS from_cache FROM documents GROUP BY sha256(text)")
def _(w):
    return intake.from_cache(intake.with_hash(w.table("documents"), "text"), _processed(w), "doc_id").select(
        "doc_id", "document_hash", "from_cache")


#: Text that an extractor can't handle gives no JSON; the rule reads the text, so copies fail alike.
_EXTRACTED = "CASE WHEN length(text) % 11 = 0 THEN 'no answer' ELSE concat('{\"size\": ', length(text), ', \"start\": \"', left(source, 4), '\"}') END"


@query("processed_documents", f"""
SELECT f.doc_id, h AS document_hash, length(d.text) % 11 <> 0 AND h IN {_PROCESSED} AS from_cache, CASE WHEN length(d.text) % 11 = 0 THEN 'invalid_json' ELSE 'ok' END AS ingest_status,
  CASE WHEN length(d.text) % 11 <> 0 THEN length(d.text) END AS size,
  CASE WHEN length(d.text) % 11 <> 0 THEN left((SELECT source FROM documents s WHERE s.doc_id = coalesce(f.first_seen, f.doc_id)), 4) END AS start
FROM (SELECT sha256(text) AS h, min(doc_id) AS doc_id, min(doc_id) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS first_seen FROM documents GROUP BY sha256(text)) f
JOIN documents d ON d.doc_id = f.doc_id""")
def _(w):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("start", T.StringType())])
    store = ResultStore(w.spark, f"{shared_folder(w.spark)}/results-{uuid.uuid4().hex}")
    extract = lambda rows: rows.withColumn("output_text", F.expr(_EXTRACTED))
    documents = intake.with_hash(w.table("documents"), "text")
    earlier = documents.join(w.table("labels"), "doc_id", "left_semi")
    pipelines.process_documents(earlier, store, "doc_id", extract=extract, schema=schema)
    return pipelines.process_documents(documents, store, "doc_id", extract=extract, schema=schema).select(
        "doc_id", "document_hash", "from_cache", "ingest_status", "record.size", "record.start")


@query("resume_json_ingest", """
SELECT event_id, CASE WHEN t = '' THEN 'empty_output' WHEN NOT json_valid(t) THEN 'invalid_json'
  WHEN json_type(t) <> 'OBJECT' OR json_type(t, '$.k') NOT IN ('UBIGINT', 'BIGINT') THEN 'invalid_schema' ELSE 'ok' END AS ingest_status,
  CASE WHEN json_valid(t) AND json_type(t) = 'OBJECT' THEN TRY_CAST(json_extract(t, '$.k') AS INT) END AS k
FROM (SELECT event_id, trim(regexp_replace(regexp_replace(trim(output_text), '^```(json)?', ''), '```$', ''), ' ' || chr(10)) AS t FROM fx_raw_json)""")
def _(w):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.IntegerType())])
    return intake.ingest_json(w.view("fx_raw_json"), "output_text", schema, ["k"]).select(
        "event_id", "ingest_status", F.col("record.k").alias("k"))


@query("standard_titles", "SELECT DISTINCT job_title FROM fx_jd")
def _(w):
    return tables.standard_titles(w.jd)


@query("response_triage", """
SELECT event_id, code, CASE WHEN code = 'model_refusal' THEN 'llm_call' WHEN code = 'invalid_schema' THEN 'output_validate'
  WHEN code IS NOT NULL THEN 'output_parse' END AS stage, CASE WHEN code IS NOT NULL THEN code NOT IN ('model_refusal', 'output_truncated') END AS retryable
FROM (SELECT event_id, CASE WHEN n_choices <> 1 THEN 'invalid_choices'
    WHEN coalesce(refusal, '') <> '' OR coalesce(finish_reason, '') = 'content_filter' THEN 'model_refusal'
    WHEN coalesce(finish_reason, '') = 'length' THEN 'output_truncated'
    WHEN coalesce(finish_reason, '') <> 'stop' OR has_tool_calls THEN 'unexpected_finish'
    WHEN trim(content) = '' THEN 'empty_output' WHEN NOT json_valid(content) THEN 'invalid_json'
    WHEN json_type(content, '$.k') NOT IN ('UBIGINT', 'BIGINT') THEN 'invalid_schema' END AS code FROM fx_responses)""")
def _(w):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.IntegerType())])
    return responses.triage_responses(w.view("fx_responses"), schema).select("event_id", "code", "stage", "retryable")


@query("report_triage", """
SELECT event_id, CASE WHEN event_id % 14 = 0 THEN NULL ELSE 'invalid_schema' END AS code, CASE WHEN event_id % 14 = 0 THEN NULL ELSE 'output_validate' END AS stage,
  CASE WHEN event_id % 14 = 0 THEN NULL ELSE TRUE END AS retryable,
  CASE event_id % 14 WHEN 0 THEN 0 WHEN 1 THEN 9 WHEN 3 THEN 5 WHEN 7 THEN 2 WHEN 11 THEN 12 WHEN 13 THEN 9 ELSE 1 END AS error_count
FROM fx_report_json""")
def _(w):
    rows = w.view("fx_report_json").select(
        "event_id", "content", F.lit(1).alias("n_choices"), F.lit(None).cast("string").alias("refusal"), F.lit("stop").alias("finish_reason"),
        F.lit(False).alias("has_tool_calls"))
    return responses.triage_responses(rows, REPORT, closed=True).select(
        "event_id", "code", "stage", "retryable", F.size(strict.json_errors(F.col("content"), REPORT, True)).alias("error_count"))


@query("resume_strict_ingest", """
SELECT doc_id, CASE doc_id % 12 WHEN 8 THEN 'invalid_json' WHEN 10 THEN 'empty_output' WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 9 THEN 'ok' ELSE 'invalid_schema' END AS ingest_status,
  CASE WHEN doc_id % 12 IN (0, 1, 9) THEN (SELECT d.source FROM documents d WHERE d.doc_id = r.doc_id) END AS name,
  CASE doc_id % 12 WHEN 6 THEN 2 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 8 THEN 0 WHEN 9 THEN 0 WHEN 10 THEN 0 ELSE 1 END AS error_count
FROM fx_resume_json r""")
def _(w):
    return intake.ingest_json(w.view("fx_resume_json"), "output_text").select(
        "doc_id", "ingest_status", F.col("record.basic_info.name").alias("name"), F.size("schema_errors").alias("error_count"))


@query("ingest_quality", """
SELECT resume_id, n AS issue_count, CASE WHEN b THEN n ELSE 0 END AS blocking_count,
  CASE WHEN b THEN 'review_required' WHEN n > 0 THEN 'review_recommended' ELSE 'auto_approved' END AS quality_status, NOT b AS can_analyze
FROM (SELECT sha256(text) AS resume_id, CASE min(doc_id) % 12 WHEN 0 THEN 0 WHEN 9 THEN 0 WHEN 6 THEN 2 ELSE 1 END AS n, min(doc_id) % 12 NOT IN (0, 1, 9) AS b
FROM fx_resume_json GROUP BY sha256(text))""")
def _(w):
    documents = intake.with_hash(w.view("fx_resume_json"), "text")
    nothing = documents.select("document_hash").where("false")
    return pipelines.judge_resumes(pipelines.ingest_resumes(documents, nothing, "doc_id"))


# ---- text functions -------------------------------------------------------------------------------


@query("fn_collapse_ws", f"SELECT doc_id, {R.collapse('text')} AS collapsed FROM documents")
def _(w):
    return w.table("documents").select("doc_id", X.collapse_ws(F.col("text")).alias("collapsed"))


@query("fn_clean_optional", f"SELECT id, {R.optional('work_experience_raw')} AS experience, {R.optional('department')} AS department FROM fx_jd")
def _(w):
    return w.jd.select("id", X.clean_optional(F.col("work_experience_raw")).alias("experience"),
                       X.clean_optional(F.col("department")).alias("department"))


@query("fn_clean_list", f"SELECT doc_id, array_to_string({R.clean_list('l')}, '|') AS items FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def _(w):
    return w.table("documents").select("doc_id", F.array_join(X.clean_list(F.split("text", "\n")), "|").alias("items"))


@query("fn_ordered_distinct", f"SELECT doc_id, array_to_string({R.keep_first('l')}, ' ') AS words FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents)")
def _(w):
    return w.table("documents").select("doc_id", F.array_join(X.ordered_distinct(F.split("text", " ")), " ").alias("words"))


@query("check_required_text", """
SELECT id, field FROM (SELECT id, unnest(['job_title', 'department', 'minimum_education']) AS field,
  unnest([job_title, department, minimum_education]) AS v FROM fx_doc_jd) WHERE v IS NULL OR trim(v) = ''""")
def _(w):
    return query_units.check_required_text(w.doc_jd, ["id"], ["job_title", "department", "minimum_education"])


@query("fn_truncate", f"SELECT doc_id, {R.truncated('text', 1500)} AS text_1500, {R.truncated('text', 1200)} AS text_1200 FROM documents")
def _(w):
    t = F.col("text")
    return w.table("documents").select("doc_id", X.truncate(t, 1500).alias("text_1500"), X.truncate(t, 1200).alias("text_1200"))


@query("fn_slash_guard", f"""
SELECT resume_id, len(p) > 1 AND len(list_filter(p, lambda v: NOT regexp_matches(v, '{R.SUFFIX}'))) = 0 AS splits
FROM (SELECT resume_id, {R.split_clean(R.collapse('target_job_title'), '[/／]+')} AS p FROM fx_intents WHERE target_job_title IS NOT NULL)""")
def _(w):
    parts = X.split_clean(X.collapse_ws(F.col("target_job_title")), X.SLASHES)
    return w.view("fx_intents").where(F.col("target_job_title").isNotNull()).select(
        "resume_id", X.slash_guard(parts).alias("splits"))


@query("fn_clamp", "SELECT event_id, round(greatest(0, least(1, value / 50.0 - 0.5)), 6) AS clamped, isfinite(value) AS is_number FROM events")
def _(w):
    return w.table("events").select(
        "event_id", r6(X.clamp01(F.col("value") / 50.0 - 0.5)).alias("clamped"), X.is_finite(F.col("value")).alias("is_number"))


@query("check_vectors", """
SELECT chunk_id, CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'wrong_dimension' END AS problem
FROM (SELECT chunk_id, CASE WHEN chunk_id % 17 = 0 THEN embedding[1:32] ELSE embedding END AS embedding FROM fx_chunks)
WHERE embedding IS NULL OR len(embedding) <> 64""")
def _(w):
    short = F.when(F.col("chunk_id") % 17 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    return w.chunks.select("chunk_id", short.alias("e")).select(
        "chunk_id", V.vector_problem(F.col("e"), DIM).alias("problem")
    ).where("problem IS NOT NULL")


@query("cosine_pairs", """
SELECT a.vec_id AS vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS distance,
  round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 1) % (SELECT count(*) FROM embeddings)""")
def _(w):
    e = w.table("embeddings")
    n = e.count()
    other = e.select(F.col("vec_id").alias("_o"), F.col("embedding").alias("b"))
    pairs = e.join(other, F.pmod(F.col("vec_id") * 7 + 1, F.lit(n)) == F.col("_o"))
    similar = V.cosine_similarity(F.col("embedding"), F.col("b"))
    return pairs.select("vec_id", r6(1 - similar).alias("distance"), r6(similar).alias("similarity"))


_POINTER_SQL = """
SELECT doc_id, CASE WHEN source = 'other' THEN 'unknown_source' WHEN path = 'markdown' THEN 'bad_start'
  WHEN path = '/mark~2down' THEN 'bad_escape' WHEN path IN ('/markdown/0', '/lines/00') THEN 'not_found'
  WHEN trim(leaf) = '' THEN 'blank' WHEN trim(quote) = '' THEN 'blank_quote'
  WHEN strpos(leaf, quote) = 0 THEN 'quote_not_found' END AS problem, {leaf}
FROM (SELECT q.*, CASE WHEN q.source = 'resume' THEN CASE q.path WHEN '/markdown' THEN d.text WHEN '/lines/0' THEN string_split(d.text, chr(10))[1] END END AS leaf
  FROM fx_quotes q JOIN documents d ON d.doc_id = q.doc_id)"""


def _quote_documents(w) -> DataFrame:
    return w.table("documents").select(
        "doc_id", F.struct(F.col("text").alias("markdown"), F.split("text", "\n").alias("lines")).alias("resume"))


@query("evidence_pointer", _POINTER_SQL.format(leaf="leaf"))
def _(w):
    return reports.resolve_evidence(w.view("fx_quotes"), _quote_documents(w), ["doc_id"]).select("doc_id", "problem", "leaf")


@query("evidence_quotes", _POINTER_SQL.format(leaf="path, quote").replace("SELECT doc_id, CASE", "SELECT * FROM (SELECT doc_id, CASE", 1) + ") WHERE problem IS NOT NULL")
def _(w):
    return reports.check_evidence_quotes(w.view("fx_quotes"), _quote_documents(w), ["doc_id"]).select(
        "doc_id", "problem", "path", "quote")


@query("evidence_pointer_variant", """
SELECT event_id, leaf, CASE WHEN NOT starts_with(path, '/') THEN 'bad_start' WHEN NOT regexp_full_match(path, '(/([^~/]|~0|~1)*)+') THEN 'bad_escape'
  WHEN leaf IS NULL THEN 'not_found' WHEN trim(leaf) = '' THEN 'blank' WHEN trim(quote) = '' THEN 'blank_quote' WHEN strpos(leaf, quote) = 0 THEN 'quote_not_found' END AS problem
FROM (SELECT *, CASE WHEN json_valid(doc) AND regexp_full_match(path, '(/([^~/]|~0|~1)*)+') AND json_type(doc, path) = 'VARCHAR' THEN json_extract_string(doc, path) END AS leaf
  FROM fx_json_docs)""")
def _(w):
    rows = w.view("fx_json_docs")
    documents = rows.select("event_id", F.try_parse_json("doc").alias("resume"))
    evidence = rows.select("event_id", F.lit("resume").alias("source"), "path", "quote")
    return reports.resolve_evidence(evidence, documents, ["event_id"]).select("event_id", "leaf", "problem")


_UNFENCED = "regexp_replace(regexp_replace(" + R.strip("output_text") + ", '^```(json)?', ''), '```$', '')"


@query("fn_strip_fence", f"SELECT event_id, {R.strip(_UNFENCED)} AS content FROM fx_raw_json")
def _(w):
    return w.view("fx_raw_json").select("event_id", X.strip_fence(F.col("output_text")).alias("content"))


@query("fn_optional_int", "SELECT event_id, TRY_CAST(trim(retry_header) AS INT) AS number, retry_header IS NOT NULL AND NOT regexp_matches(trim(retry_header), '^[+-]?[0-9]+$') AS invalid FROM (SELECT event_id, CASE WHEN contains(retry_header, '.') THEN 'x' ELSE retry_header END AS retry_header FROM fx_responses)")
def _(w):
    text = F.when(F.contains(F.col("retry_header"), F.lit(".")), "x").otherwise(F.col("retry_header"))
    return w.view("fx_responses").select(
        "event_id", X.optional_int(text).alias("number"), X.optional_int_invalid(text).alias("invalid"))


@query("fn_retry_after", "SELECT event_id, CASE WHEN isfinite(d) AND d >= 0 THEN d END AS seconds FROM (SELECT event_id, TRY_CAST(trim(retry_header) AS DOUBLE) AS d FROM fx_responses)")
def _(w):
    return w.view("fx_responses").select("event_id", X.retry_after(F.col("retry_header")).alias("seconds"))


@query("fn_http_retryable", "SELECT event_id, http_status IN (408, 409, 429) OR http_status >= 500 AS retryable FROM fx_responses")
def _(w):
    return w.view("fx_responses").select("event_id", X.http_retryable(F.col("http_status")).alias("retryable"))


@query("fn_backoff", "SELECT event_id, greatest(least(30.0, pow(2, retry_count)), coalesce(CASE WHEN isfinite(d) AND d >= 0 THEN d END, 0))::DOUBLE AS delay FROM (SELECT *, TRY_CAST(trim(retry_header) AS DOUBLE) AS d FROM fx_responses)")
def _(w):
    return w.view("fx_responses").select(
        "event_id", X.backoff(F.col("retry_count"), X.retry_after(F.col("retry_header"))).alias("delay"))


# ---- intents and exact matching -------------------------------------------------------------------


@query("intent_normalize", "SELECT resume_id, array_to_string(job_titles, '|') AS job_titles, is_multi_intent FROM o_intents")
def _(w):
    return w.intents.select("resume_id", joined("job_titles"), "is_multi_intent")


@query("intent_targets", "SELECT resume_id, target_id, target_pos, requested_job_title FROM o_targets UNION ALL SELECT resume_id, 'rejected', 0, 'no_valid_target_title' FROM o_intents WHERE len(job_titles) = 0")
def _(w):
    lost = intents.reject_without_targets(w.intents).select(
        "resume_id", F.lit("rejected").alias("target_id"), F.lit(0).alias("target_pos"), F.col("reason").alias("requested_job_title"))
    return w.targets.unionByName(lost)


@query("exact_direct", "SELECT resume_id, target_id, jd_id, department FROM o_exact_cands WHERE match_type = 'direct'")
def _(w):
    return exact.direct_matches(w.targets, w.jd).select("resume_id", "target_id", "jd_id", "department")


@query("exact_alias", "SELECT resume_id, target_id, requested_job_title, job_title, jd_id FROM o_exact_cands WHERE match_type = 'alias'")
def _(w):
    return exact.alias_matches(w.targets, w.jd, w.alias).select(
        "resume_id", "target_id", "requested_job_title", "job_title", "jd_id")


@query("exact_match", "SELECT resume_id, target_id, requested_job_title, normalized_title, match_type, n_jds, CASE WHEN match_type IS NULL THEN 'unresolved' ELSE 'matched' END AS status FROM o_match")
def _(w):
    return w.matches.select("resume_id", "target_id", "requested_job_title", "normalized_title", "match_type", "n_jds", "status")


@query("exact_match_repeated_alias", "SELECT resume_id, target_id, normalized_title, match_type, n_jds FROM o_match")
def _(w):
    """Aliases listed twice, and once more with another title, change nothing."""
    return exact.exact_match(w.targets, w.jd, w.view("fx_alias_twice")).select(
        "resume_id", "target_id", "normalized_title", "match_type", "n_jds")


@query("check_alias_conflicts", "SELECT alias_title, min(standard_title) AS standard_title, count(DISTINCT standard_title) AS title_count FROM fx_alias_twice GROUP BY alias_title HAVING count(DISTINCT standard_title) > 1")
def _(w):
    return exact.alias_conflicts(w.view("fx_alias_twice"))


@query("exact_unresolved", "SELECT resume_id, target_id, requested_job_title FROM o_match WHERE match_type IS NULL")
def _(w):
    return w.open_targets.select("resume_id", "target_id", "requested_job_title")


@query("exact_candidates", "SELECT resume_id, target_id, match_type, jd_id, job_title, department, candidate_rank FROM o_exact_cands")
def _(w):
    return w.exact_candidates.select("resume_id", "target_id", "match_type", "jd_id", "job_title", "department", "candidate_rank")


_PAGE = """
SELECT m.resume_id, m.target_id, m.n_jds, {p} AS page, coalesce(string_agg(c.jd_id || ' ' || c.candidate_rank, ',' ORDER BY c.candidate_rank), '') AS candidates
FROM o_match m LEFT JOIN o_exact_cands c ON c.resume_id = m.resume_id AND c.target_id = m.target_id AND (c.candidate_rank - 1) // 4 = {p} GROUP BY ALL"""


def _pages(w, page) -> DataFrame:
    listed = F.transform("candidates", lambda c: F.concat_ws(" ", c["jd_id"].cast("string"), c["candidate_rank"].cast("string")))
    return exact.candidate_page(w.matches, exact.candidate_pages(w.jd, 4), page).select(
        "resume_id", "target_id", "n_jds", "page", F.array_join(listed, ",").alias("candidates"))


@query("candidate_first_page", _PAGE.format(p="0"))
def _(w):
    return _pages(w, 0)


@query("candidate_asked_page", _PAGE.format(p="m.resume_id % 3"))
def _(w):
    return _pages(w, (F.col("resume_id") % 3).cast("int"))


@query("lookup_titles", "SELECT id, job_title FROM fx_jd WHERE job_title IN (SELECT requested_job_title FROM o_targets) ORDER BY job_title, id")
def _(w):
    return exact.lookup_by_titles(w.jd, w.targets, "requested_job_title").select("id", "job_title")


@query("lookup_chunk", "SELECT e.event_id, c.chunk_id, c.jd_id, c.chunk_type, c.content FROM events e JOIN fx_chunks c ON c.chunk_id = e.event_id % (SELECT count(*) + 50 FROM embeddings)")
def _(w):
    n = w.table("embeddings").count() + 50
    asked = w.table("events").select("event_id", (F.col("event_id") % n).alias("chunk_id"))
    return asked.join(w.chunks.select("chunk_id", "jd_id", "chunk_type", "content"), "chunk_id")


@query("lookup_ids_ordered", f"""
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS position, id, job_title FROM (
  SELECT o_orderkey AS request_id, unnest(range(4)) AS pos, unnest(list_resize({R.keep_first('ids')}, 4)) AS id
  FROM (SELECT o_orderkey, [o_custkey, o_orderkey % 77, o_custkey, 900000000 + o_orderkey] AS ids FROM orders)) x
JOIN fx_jd USING (id)""")
def _(w):
    ids = F.array("o_custkey", F.col("o_orderkey") % 77, "o_custkey", F.col("o_orderkey") + 900000000)
    requests = w.table("orders").select(F.col("o_orderkey").alias("request_id"), ids.alias("ids"))
    from pyspark.sql import Window

    found = exact.lookup_ids_ordered(requests, w.jd.select("id", "job_title"))
    return found.withColumn("position", F.row_number().over(Window.partitionBy("request_id").orderBy("pos"))).drop("pos")


# ---- similarity -----------------------------------------------------------------------------------

_HIT_SQL = "SELECT resume_id, target_id, query_id, chunk_id, jd_id, chunk_rank, round(distance, 6) + 0.0 AS distance, round(similarity, 6) + 0.0 AS similarity FROM {p}hits"


def _hit_rows(hits: DataFrame) -> DataFrame:
    return hits.select("resume_id", "target_id", "query_id", "chunk_id", "jd_id", "chunk_rank", r6("distance"), r6("similarity"))


@query("knn_topk", _HIT_SQL.format(p="q_"))
def _(w):
    return _hit_rows(w.hits())


@query("knn_many_blocks", _HIT_SQL.format(p="q_"))
def _(w):
    """The same search over many cells and blocks."""
    return _hit_rows(w.hits(block_rows=128))


@query("knn_chunk_types", _HIT_SQL.format(p="t_"), R.recall_tables("t_", "fx_vqueries", hit_filter="c.chunk_type IN ('responsibility', 'competency')"))
def _(w):
    return _hit_rows(w.hits(chunk_types=["responsibility", " competency ", ""]))


@query("knn_exclude", _HIT_SQL.format(p="x_"), R.recall_tables("x_", "fx_vqueries", hit_filter="(q.resume_id, c.jd_id) NOT IN (SELECT user_id, event_id % 40 FROM events)"))
def _(w):
    rejected = w.table("events").select(
        F.col("user_id").alias("resume_id"), F.lit("target_1").alias("target_id"), (F.col("event_id") % 40).alias("jd_id"))
    return _hit_rows(w.hits(rejected=rejected))


# ---- query units ----------------------------------------------------------------------------------

_UNIT_COLUMNS = ["resume_id", "target_id", "query_id", "query_type", "text", "resume_evidence_text", "source_index"]
for _name, _kind in {"title": TITLE, "work": WORK, "project": PROJECT, "skills": SKILLS}.items():
    query(f"query_units_{_name}", f"SELECT {', '.join(_UNIT_COLUMNS)} FROM u_{_name}")(
        lambda w, kind=_kind: query_units.units_of_kind(w.open_targets, w.resumes, kind).select(*_UNIT_COLUMNS))


@query("query_units", f"SELECT {', '.join(_UNIT_COLUMNS)}, query_order, weight FROM u_all")
def _(w):
    return query_units.query_units(w.open_targets, w.resumes).select(*_UNIT_COLUMNS, "query_order", "weight")


@query("query_build_warnings", "SELECT resume_id, target_id, warnings FROM u_warnings")
def _(w):
    return query_units.unit_arrays(w.open_targets, w.resumes).select("resume_id", "target_id", joined("warnings"))


_BAD_UNITS = """
SELECT resume_id, CASE WHEN resume_id % 40 = 5 THEN ' ' ELSE target_id END AS target_id, text,
  CASE WHEN resume_id % 7 = 0 THEN 'same' WHEN resume_id % 23 = 0 THEN '' ELSE query_id END AS query_id,
  CASE WHEN resume_id % 11 = 0 THEN requested_job_title || query_id ELSE requested_job_title END AS requested_job_title FROM u_all"""


@query("check_query_units", """
SELECT * FROM (SELECT resume_id, target_id, count(*) AS n_units, CASE WHEN trim(target_id) = '' THEN 'blank_target_id'
  WHEN count(DISTINCT trim(requested_job_title)) <> 1 THEN 'title_not_unique' WHEN bool_or(trim(query_id) = '') THEN 'blank_query_id'
  WHEN count(DISTINCT trim(query_id)) <> count(*) THEN 'duplicate_query_id' END AS reason
FROM bad_units GROUP BY resume_id, target_id) WHERE reason IS NOT NULL""", {"bad_units": _BAD_UNITS})
def _(w):
    r = F.col("resume_id")
    units = query_units.query_units(w.open_targets, w.resumes)
    broken = units.withColumns({
        "target_id": F.when(r % 40 == 5, " ").otherwise(F.col("target_id")),
        "query_id": F.when(r % 7 == 0, "same").when(r % 23 == 0, "").otherwise(F.col("query_id")),
        "requested_job_title": F.when(r % 11 == 0, F.concat("requested_job_title", "query_id")).otherwise(F.col("requested_job_title")),
    })
    return recall.check_query_units(broken)


# ---- passages -------------------------------------------------------------------------------------

_DOC_HEADER = f"'公司岗位名称：' || {R.collapse('job_title')} || CASE WHEN department IS NOT NULL THEN chr(10) || '所属部门：' || department ELSE '' END"
_PACKING = {
    "doc_lines": f"""
SELECT id, {_DOC_HEADER} AS header, 0 AS block, 'qualification' AS prefix, list_filter([
    '最低学历：' || minimum_education, {R.labelled('专业背景', R.collapse('education_background'))}, '工作经验要求：' || {R.collapse('work_experience_raw')}], lambda v: v IS NOT NULL) AS lines
FROM fx_doc_jd WHERE id IS NOT NULL AND trim(job_title) <> ''
UNION ALL
SELECT id, {_DOC_HEADER}, 1, 'responsibility_0', list_filter(['岗位职责：' || description], lambda v: v IS NOT NULL)
  || list_transform({R.clean_list("string_split(text, chr(10))")}, lambda v: '具体任务：' || v)
FROM fx_doc_jd WHERE id IS NOT NULL AND trim(job_title) <> '' AND has_lines
UNION ALL
SELECT id, {_DOC_HEADER}, 2, 'responsibility_2', ['岗位职责：report results'] || list_transform({R.clean_list('[education_background]')}, lambda v: '具体任务：' || v)
FROM fx_doc_jd WHERE id IS NOT NULL AND trim(job_title) <> '' AND has_lines
UNION ALL
SELECT id, {_DOC_HEADER}, 3, 'competency', list_transform({R.clean_list("string_split(text, '. ')")}, lambda v: '胜任能力：' || v)
FROM fx_doc_jd WHERE id IS NOT NULL AND trim(job_title) <> '' AND has_lines""",
    "doc_cut": f"""
SELECT id, header, block, prefix, list_transform(lines, lambda v: {R.rstrip('substring(v, 1, 1200)')}) AS lines FROM doc_lines WHERE len(lines) > 0""",
}
# list_reduce over single-item lists: the accumulator is the list of finished and open passage bodies.
_PACKING["doc_packed"] = """
SELECT id, header, block, prefix, list_reduce(wrapped, lambda acc, v: CASE
    WHEN length(acc[-1]) + length(v[1]) + length(header) + 2 > 1200 THEN acc || v
    ELSE acc[:-2] || [acc[-1] || chr(10) || v[1]] END) AS bodies
FROM (SELECT id, header, block, prefix, list_transform(lines, lambda v: [v]) AS wrapped FROM doc_cut)"""
_PACKING["doc_passages"] = f"""
SELECT id AS jd_id, block, i, prefix || '_part_' || (i - 1) AS section, {R.rstrip("substring(header || chr(10) || body, 1, 1200)")} AS text
FROM (SELECT id, header, block, prefix, unnest(range(1, len(bodies) + 1)) AS i, unnest(bodies) AS body FROM doc_packed)"""


@query("jd_passages", f"""
SELECT jd_id, row_number() OVER (PARTITION BY jd_id ORDER BY block, i) - 1 AS passage_pos, section, text FROM doc_passages
UNION ALL
SELECT id, 0, 'title_only', {_DOC_HEADER} FROM fx_doc_jd
WHERE id IS NOT NULL AND trim(job_title) <> '' AND id NOT IN (SELECT jd_id FROM doc_passages)""", _PACKING)
def _(w):
    return passages.jd_passages(passages.jd_documents(w.doc_jd))


@query("jd_build_rejects", "SELECT id, CASE WHEN id IS NULL THEN 'missing_id' ELSE 'missing_job_title' END AS reason FROM fx_doc_jd WHERE id IS NULL OR trim(job_title) = ''")
def _(w):
    return passages.jd_build_rejects(w.doc_jd)


# ---- recall ---------------------------------------------------------------------------------------


@query("type_weight_plan", "SELECT DISTINCT resume_id, target_id, query_type, n_queries_of_type, active_types, penalty, round(normalized_type_weight, 6) AS normalized_type_weight, round(effective_type_weight, 6) AS effective_type_weight FROM q_weights")
def _(w):
    return recall.type_weight_plan(w.weighted).withColumns({c: r6(c) for c in ("normalized_type_weight", "effective_type_weight")})


@query("query_effective_weights", "SELECT resume_id, target_id, query_id, query_type, round(effective_weight, 6) AS effective_weight FROM q_weights")
def _(w):
    return w.weighted.select("resume_id", "target_id", "query_id", "query_type", r6("effective_weight"))


@query("recall_min_similarity", "SELECT resume_id, target_id, query_id, chunk_id FROM q_hits WHERE similarity >= 0.2")
def _(w):
    return recall.usable_hits(w.hits(), RecallConfig(minimum_similarity=0.2)).select(
        "resume_id", "target_id", "query_id", "chunk_id")


@query("best_chunk_per_query_jd", "SELECT resume_id, target_id, query_id, jd_id, chunk_id, chunk_hits, round(similarity, 6) + 0.0 AS similarity FROM q_best")
def _(w):
    return w.best.select("resume_id", "target_id", "query_id", "jd_id", "chunk_id", "chunk_hits", r6("similarity"))


_CAND = "resume_id, target_id, jd_id, total_query_count, matched_query_count, chunk_hit_count"
_CAND_SCORES = ("title_query_similarity", "best_similarity", "evidence_score", "weighted_query_coverage", "aggregate_score")
_CAND_SQL = _CAND + "".join(f", round({c}, 6) + 0.0 AS {c}" for c in _CAND_SCORES)


@query("recall_candidates", f"SELECT {_CAND_SQL} FROM q_cands")
def _(w):
    return w.candidates.select(*_CAND.split(", "), *[r6(c) for c in _CAND_SCORES])


@query("recall_ranked", f"SELECT {_CAND_SQL}, recall_rank FROM q_recalled")
def _(w):
    return recall.ranked_candidates(w.candidate_lists, 10).select(*_CAND.split(", "), *[r6(c) for c in _CAND_SCORES], "recall_rank")


_BREAKDOWN = """
SELECT c.resume_id, c.target_id, c.jd_id, p.query_type, p.n_queries_of_type, p.effective_type_weight,
  coalesce(m.n, 0) AS matched_query_count, m.best AS best_similarity, coalesce(m.contribution, 0.0::DOUBLE) AS weighted_contribution,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(m.matched, 0.0::DOUBLE) / p.effective_type_weight)) AS query_coverage
FROM q_cands c JOIN (SELECT DISTINCT resume_id, target_id, query_type, n_queries_of_type, effective_type_weight FROM q_weights) p USING (resume_id, target_id)
LEFT JOIN (SELECT resume_id, target_id, jd_id, query_type, count(*) AS n, sum(effective_weight) AS matched, max(similarity) AS best,
  sum(weighted_similarity) AS contribution FROM q_evid GROUP BY ALL) m USING (resume_id, target_id, jd_id, query_type)"""


def _breakdown(w) -> DataFrame:
    return recall.type_breakdown(w.candidates, w.evidence, recall.type_weight_plan(w.weighted))


@query("recall_type_breakdown", "SELECT resume_id, target_id, jd_id, query_type, n_queries_of_type, matched_query_count, round(effective_type_weight, 6) AS effective_type_weight, round(best_similarity, 6) + 0.0 AS best_similarity, round(weighted_contribution, 6) + 0.0 AS weighted_contribution, round(query_coverage, 6) + 0.0 AS query_coverage FROM breakdown", {"breakdown": _BREAKDOWN})
def _(w):
    return _breakdown(w).select(
        "resume_id", "target_id", "jd_id", "query_type", "n_queries_of_type", "matched_query_count",
        *[r6(c) for c in ("effective_type_weight", "best_similarity", "weighted_contribution", "query_coverage")])


@query("check_contribution_sum", "SELECT c.resume_id, c.target_id, c.jd_id, round(c.evidence_score, 6) + 0.0 AS evidence_score, round(s.total, 6) + 0.0 AS contribution_sum, abs(c.evidence_score - s.total) <= 1e-9 AS consistent FROM q_cands c JOIN (SELECT resume_id, target_id, jd_id, sum(weighted_contribution) AS total FROM breakdown GROUP BY ALL) s USING (resume_id, target_id, jd_id)", {"breakdown": _BREAKDOWN})
def _(w):
    return recall.check_contribution_sum(w.candidates, _breakdown(w)).select(
        "resume_id", "target_id", "jd_id", r6("evidence_score"), r6("contribution_sum"), "consistent")


@query("recall_evidence", """
SELECT * EXCLUDE (s), round(s, 6) + 0.0 AS weighted_similarity FROM (SELECT resume_id, target_id, jd_id, query_id, chunk_id, weighted_similarity AS s,
  row_number() OVER (PARTITION BY resume_id, target_id, jd_id ORDER BY round(weighted_similarity, 12) DESC, round(similarity, 12) DESC, query_order, query_id) AS evidence_rank FROM q_evid)
WHERE evidence_rank <= 10""")
def _(w):
    return recall.visible_evidence(w.evidence).select(
        "resume_id", "target_id", "jd_id", "query_id", "chunk_id", r6("weighted_similarity"), "evidence_rank")


@query("recall_summary", """
SELECT resume_id, target_id, n AS total_query_count, coalesce(r, 0) AS total_retrieved, coalesce(u, 0) AS total_usable,
  coalesce(c, 0) AS candidates_before_limit, least(coalesce(c, 0), 10) AS returned
FROM (SELECT resume_id, target_id, count(*) AS n FROM fx_vqueries GROUP BY ALL)
LEFT JOIN (SELECT resume_id, target_id, count(*) AS r, count_if(similarity >= 0.1) AS u, count(DISTINCT CASE WHEN similarity >= 0.1 THEN jd_id END) AS c FROM q_hits GROUP BY ALL)
USING (resume_id, target_id)""")
def _(w):
    cfg = RecallConfig(minimum_similarity=0.1)
    hits = materialize(w.hits(), "hits")  # read twice
    kept = recall.query_evidence(recall.best_chunk_per_query(hits, cfg), w.weighted)
    return recall.recall_summary(w.weighted, hits, recall.recall_candidates(kept, cfg), cfg)


@query("check_recall_input", """
SELECT resume_id, target_id, count(*) AS n_queries, count_if(qt = 'target_job_title') AS n_title_queries,
  CASE WHEN count(DISTINCT qid) <> count(*) THEN 'query_id_not_unique' WHEN bool_or(qt = 'hobby') THEN 'unknown_query_type'
    WHEN bool_or(wt <= 0) THEN 'bad_weight' WHEN count_if(qt = 'target_job_title') <> 1 THEN 'title_query_count' END AS reason
FROM (SELECT resume_id, target_id, CASE WHEN resume_id % 9 = 0 THEN 'q' ELSE query_id END AS qid,
  CASE WHEN resume_id % 10 = 3 AND query_order = 2 THEN 'hobby' WHEN resume_id % 10 = 4 AND query_order = 0 THEN 'skills' ELSE query_type END AS qt,
  CASE WHEN resume_id % 8 = 1 THEN 0 ELSE weight END AS wt FROM fx_queries) GROUP BY ALL""")
def _(w):
    r, o = F.col("resume_id"), F.col("query_order")
    broken = w.vectors.drop("embedding").withColumns({
        "query_id": F.when(r % 9 == 0, "q").otherwise(F.col("query_id")),
        "query_type": F.when((r % 10 == 3) & (o == 2), "hobby").when((r % 10 == 4) & (o == 0), SKILLS).otherwise(F.col("query_type")),
        "weight": F.when(r % 8 == 1, 0.0).otherwise(F.col("weight")),
    })
    return recall.check_recall_input(broken, w.hits())


# ---- rerank ---------------------------------------------------------------------------------------


@query("rerank_missing_jds", "SELECT resume_id, target_id, jd_id, recall_rank FROM q_recalled WHERE jd_id NOT IN (SELECT id FROM fx_jd)")
def _(w):
    return rerank.missing_documents(w.recalled, w.documents).select("resume_id", "target_id", "jd_id", "recall_rank")


@query("title_pairs", "SELECT resume_id, target_id, jd_id, left_text, right_text FROM q_title_pairs")
def _(w):
    return w.title_pairs.select("resume_id", "target_id", "jd_id", "left_text", "right_text")


_SUPPORT = "resume_id, target_id, jd_id, query_id, query_type, passage_pos, section, left_text, right_text"


@query("support_pairs", f"SELECT {_SUPPORT} FROM q_support_pairs")
def _(w):
    return w.support_pairs.select(*_SUPPORT.split(", "))


@query("score_pairs", "SELECT resume_id, target_id, jd_id, 'title' AS kind, NULL AS query_id, NULL AS section, left_text, right_text FROM q_title_pairs UNION ALL SELECT resume_id, target_id, jd_id, 'support', query_id, section, left_text, right_text FROM q_support_pairs")
def _(w):
    return rerank.score_pairs_input(w.title_pairs, w.support_pairs)


@query("pair_scores", f"SELECT resume_id, target_id, jd_id, kind, query_id, section, round({R.jaccard('left_text', 'right_text')}, 6) AS score FROM (SELECT resume_id, target_id, jd_id, 'title' AS kind, NULL AS query_id, NULL AS section, left_text, right_text FROM q_title_pairs UNION ALL SELECT resume_id, target_id, jd_id, 'support', query_id, section, left_text, right_text FROM q_support_pairs)")
def _(w):
    return rerank.score_pairs(rerank.score_pairs_input(w.title_pairs, w.support_pairs)).select(
        "resume_id", "target_id", "jd_id", "kind", "query_id", "section", r6("score"))


@query("support_best_passage", "SELECT resume_id, target_id, jd_id, query_id, passage_pos, section, round(score, 6) AS score FROM q_best_passage")
def _(w):
    return w.best_passages.select("resume_id", "target_id", "jd_id", "query_id", "passage_pos", "section", r6("score"))


@query("support_type_scores", "SELECT resume_id, target_id, jd_id, query_type, query_count, round(normalized_weight, 6) AS normalized_weight, round(mean_best_score, 6) AS mean_best_score, round(weighted_contribution, 6) AS weighted_contribution FROM q_type_scores")
def _(w):
    return w.type_scores.select("resume_id", "target_id", "jd_id", "query_type", "query_count",
                                *[r6(c) for c in ("normalized_weight", "mean_best_score", "weighted_contribution")])


@query("support_scores", f"SELECT r.resume_id, r.target_id, r.jd_id, round({R.clamp('coalesce(s.total, 0.0::DOUBLE)')}, 6) AS resume_support_score FROM q_recalled r LEFT JOIN (SELECT resume_id, target_id, jd_id, sum(weighted_contribution) AS total FROM q_type_scores GROUP BY ALL) s USING (resume_id, target_id, jd_id)")
def _(w):
    return rerank.support_scores(w.recalled, w.type_scores).select("resume_id", "target_id", "jd_id", r6("resume_support_score"))


@query("support_evidence", "SELECT * EXCLUDE (s), round(s, 6) AS score FROM (SELECT resume_id, target_id, jd_id, query_id, section, score AS s, row_number() OVER (PARTITION BY resume_id, target_id, jd_id ORDER BY round(score, 12) DESC, query_order, query_id) AS evidence_rank FROM q_best_passage) WHERE evidence_rank <= 10")
def _(w):
    return rerank.support_evidence(w.best_passages).select(
        "resume_id", "target_id", "jd_id", "query_id", "section", r6("score"), "evidence_rank")


_RR = "resume_id, target_id, jd_id, job_title, department, recall_rank"
_RR_SCORES = ("recall_score", "title_similarity", "resume_support_score", "resolution_score")
_RR_SQL = _RR + "".join(f", round({c}, 6) + 0.0 AS {c}" for c in _RR_SCORES)


@query("rerank_candidates", f"SELECT {_RR_SQL}, TRUE AS passes_title_threshold FROM q_rcands")
def _(w):
    return w.rerank_candidates.select(*_RR.split(", "), *[r6(c) for c in _RR_SCORES], "passes_title_threshold")


@query("rerank_ranked", f"SELECT {_RR_SQL}, rerank_rank FROM q_ranked")
def _(w):
    return rerank.ranked_rerank(w.rerank_candidates).select(*_RR.split(", "), *[r6(c) for c in _RR_SCORES], "rerank_rank")


_DECIDED = "resume_id, target_id, requested_job_title, status, recall_count, reranked_count, missing_jd_ids, recommended_jd_id, round(top_margin, 6) + 0.0 AS top_margin, candidates, decision_warnings AS warnings"


def _decision_rows(decided: DataFrame, warnings: str) -> DataFrame:
    return decided.select(
        "resume_id", "target_id", "requested_job_title", "status", "recall_count", "reranked_count",
        F.array_join(F.col("missing_jd_ids").cast("array<string>"), "、").alias("missing_jd_ids"), "recommended_jd_id",
        r6("top_margin"), F.array_join(F.coalesce(F.col("candidates.jd_id").cast("array<string>"), F.array()), ",").alias("candidates"),
        F.array_join(warnings, "|").alias("warnings"),
    )


@query("rerank_decision", f"SELECT {_DECIDED} FROM q_decided")
def _(w):
    ranked = rerank.ranked_rerank(w.rerank_candidates)
    missing = rerank.missing_documents(w.recalled, w.documents)
    return _decision_rows(rerank.rerank_decision(w.titles, w.recalled, missing, ranked), "decision_warnings")


_AUTO = {
    "x_ranked": """
SELECT * FROM (SELECT *, title_similarity >= 0.2::DOUBLE AS passes, row_number() OVER (PARTITION BY resume_id, target_id ORDER BY title_similarity >= 0.2::DOUBLE DESC,
  round(resolution_score, 12) DESC, round(title_similarity, 12) DESC, round(resume_support_score, 12) DESC, round(recall_score, 12) DESC, recall_rank) AS rerank_rank
  FROM q_rcands) WHERE rerank_rank <= 5""",
    "x_kept": """
SELECT resume_id, target_id, count_if(passes) AS eligible, max(CASE WHEN passes AND rerank_rank = 1 THEN jd_id END) AS first_id,
  max(CASE WHEN passes AND rerank_rank = 1 THEN resolution_score END) AS s1, max(CASE WHEN passes AND rerank_rank = 2 THEN resolution_score END) AS s2
FROM x_ranked GROUP BY ALL""",
    "x_decided": """
SELECT t.resume_id, t.target_id, k.first_id AS recommended_jd_id, CASE WHEN k.eligible > 1 THEN k.s1 - k.s2 END AS margin,
  CASE WHEN k.eligible IS NULL THEN 'no_candidate' WHEN k.eligible = 0 THEN 'no_eligible_candidate'
    WHEN round(k.s1, 12) >= 0.25 AND (k.eligible = 1 OR round(k.s1 - k.s2, 12) >= 0.02) THEN 'auto_resolved' ELSE 'needs_confirmation' END AS status,
  round(k.s1, 12) >= 0.25 AS score_ok
FROM q_titles t LEFT JOIN x_kept k USING (resume_id, target_id)""",
}


@query("rerank_decision_auto", """
SELECT resume_id, target_id, status, recommended_jd_id, CASE WHEN status = 'auto_resolved' THEN recommended_jd_id END AS selected_jd_id,
  status IN ('needs_confirmation', 'no_eligible_candidate') AS needs_confirmation, round(margin, 6) + 0.0 AS top_margin FROM x_decided""", _AUTO)
def _(w):
    """Automatic resolution, with a floor under the title similarity."""
    cfg = RerankConfig(
        require_manual_confirmation=False, auto_confirm_threshold=0.25, minimum_top_margin=0.02, minimum_title_similarity=0.2)
    titles = rerank.title_scores(w.recalled, w.documents)
    ranked = rerank.ranked_rerank(rerank.rerank_candidates(titles, w.type_scores, cfg), cfg)
    decided = rerank.rerank_decision(w.titles, w.recalled, rerank.missing_documents(w.recalled, w.documents), ranked, cfg)
    return decided.select("resume_id", "target_id", "status", "recommended_jd_id", "selected_jd_id", "needs_confirmation", r6("top_margin"))


class _Failing:
    """Token Jaccard that raises on some texts."""

    def __call__(self, pairs):
        if any((len(a) + len(b)) % 61 == 0 for a, b in pairs):
            raise ValueError("unreadable pair")
        sets = [[{t for t in x.lower().split(" ") if t} for x in pair] for pair in pairs]
        return [len(a & b) / len(a | b) if a | b else 0.0 for a, b in sets]


@query("rerank_isolated_errors", f"""
SELECT d.resume_id, d.target_id, d.requested_job_title, d.recall_count, CASE WHEN b.target_id IS NOT NULL THEN 'ValueError' END AS error,
  CASE WHEN b.target_id IS NULL THEN d.recommended_jd_id END AS recommended_jd_id, CASE WHEN b.target_id IS NULL THEN d.candidates ELSE '' END AS candidates
FROM q_decided d LEFT JOIN (SELECT DISTINCT resume_id, target_id FROM (
    SELECT resume_id, target_id, left_text, right_text FROM q_title_pairs UNION ALL SELECT resume_id, target_id, left_text, right_text FROM q_support_pairs)
  WHERE (length({R.collapse('left_text')}) + length({R.collapse('right_text')})) % 61 = 0) b USING (resume_id, target_id)""")
def _(w):
    decided = pipelines.rerank_targets(w.titles, w.recalled, w.vectors, w.jd, scorer=ModelScorer(_Failing, "failing"))
    return decided.select(
        "resume_id", "target_id", "requested_job_title", "recall_count", "error", "recommended_jd_id",
        F.array_join(F.coalesce(F.col("candidates.jd_id").cast("array<string>"), F.array()), ",").alias("candidates"))


@query("check_rerank_input", "SELECT resume_id, target_id, count(*) AS n_candidates, count_if(jd_id IN (SELECT id FROM fx_jd)) AS n_scored, CASE WHEN any_value(resume_id) % 6 = 0 THEN 'title_differs' WHEN count_if(jd_id IN (SELECT id FROM fx_jd)) < count(*) THEN 'title_score_missing' END AS reason FROM q_recalled GROUP BY resume_id, target_id")
def _(w):
    other = F.when(F.col("resume_id") % 6 == 0, F.concat("requested_job_title", F.lit("!"))).otherwise(F.col("requested_job_title"))
    return rerank.check_rerank_input(
        w.recalled, w.vectors.drop("embedding").withColumn("requested_job_title", other), w.title_pairs)


@query("semantic_match", "SELECT d.resume_id, d.target_id, d.requested_job_title, d.status, d.recall_count, d.reranked_count, d.missing_jd_ids, d.recommended_jd_id, round(d.top_margin, 6) + 0.0 AS top_margin, d.candidates, array_to_string(list_filter([nullif(u.warnings, ''), nullif(d.decision_warnings, '')], lambda v: v IS NOT NULL), '|') AS warnings FROM m_decided d JOIN u_warnings u USING (resume_id, target_id)")
def _(w):
    decided = pipelines.semantic_match(w.open_targets, w.resumes, w.jd, w.chunks, w.embed, dim=DIM)
    return _decision_rows(decided, "warnings")


_WHOLE_MATCH = """
SELECT s.resume_id, s.target_id, s.requested_job_title, s.selected_jd_id,
  CASE WHEN d.reranked_count > 0 THEN 'needs_confirmation' ELSE s.status END AS status,
  CASE WHEN d.reranked_count > 0 THEN 'semantic' ELSE s.source END AS source,
  CASE WHEN d.reranked_count > 0 THEN d.reranked_count ELSE s.n_candidates END AS n_candidates,
  CASE WHEN d.resume_id IS NULL THEN s.warning ELSE array_to_string(list_filter([CASE WHEN d.reranked_count > 0 THEN '语义候选必须经人工确认后才能进入 Agent' END,
    nullif(u.warnings, ''), nullif(d.decision_warnings, '')], lambda v: v IS NOT NULL), '|') END AS warnings
FROM o_state s LEFT JOIN m_decided d USING (resume_id, target_id) LEFT JOIN u_warnings u USING (resume_id, target_id)"""


@query("semantic_input_notes", """
SELECT * FROM (SELECT 'blank_text' AS reason, count(*) AS n FROM u_all WHERE resume_id % 7 = 0 AND query_order = 1
  UNION ALL SELECT 'bad_weight', count(*) FROM u_all WHERE resume_id % 5 = 0 AND NOT (resume_id % 11 = 0 AND resume_id % 35 > 0 AND query_order = 2) UNION ALL SELECT 'units_lost', count(*) FROM u_all WHERE resume_id % 11 = 0 AND resume_id % 35 > 0 AND query_order = 2)
WHERE n > 0""")
def _(w):
    r, order, notes = F.col("resume_id"), F.col("query_order"), {}

    def embed(units):
        made = w.embed(units).where(~((r % 11 == 0) & (r % 35 > 0) & (order == 2)))
        return made.withColumns({
            "text": F.when((r % 7 == 0) & (order == 1), " ").otherwise(F.col("text")), "weight": F.when(r % 5 == 0, 0.0).otherwise(F.col("weight"))})

    pipelines.semantic_match(w.open_targets, w.resumes, w.jd, w.chunks, embed, dim=DIM, notes=notes)
    return w.spark.createDataFrame(sorted(notes.items()), "reason string, n bigint")


@query("match_resumes", _WHOLE_MATCH)
def _(w):
    result = pipelines.match_resumes(
        w.resumes, w.jd, w.alias, w.chunks, w.embed, dim=DIM)
    return result.select("resume_id", "target_id", "requested_job_title", "selected_jd_id", "status", "source", "n_candidates", joined("warnings"))


# ---- match state ----------------------------------------------------------------------------------

_STATE = "resume_id, target_id, requested_job_title, status, source, selected_jd_id, resolution_method, n_candidates"


@query("match_state", f"SELECT {_STATE}, warning AS warnings FROM o_state")
def _(w):
    return w.state.select(*_STATE.split(", "), joined("warnings"))


_ROLLUP = """
SELECT *, CASE WHEN resolved_count = target_count THEN 'ready' WHEN resolved_count > 0 THEN 'partially_ready'
  WHEN pending_confirmation_count > 0 THEN 'needs_confirmation' WHEN manual_resolution_count > 0 THEN 'needs_manual_resolution' ELSE 'blocked' END AS overall_status
FROM (SELECT resume_id, count(*) AS target_count, count_if(status = 'resolved') AS resolved_count,
  count_if(status = 'needs_confirmation') AS pending_confirmation_count, count_if(status = 'needs_manual_resolution') AS manual_resolution_count FROM {t} GROUP BY resume_id)"""


@query("match_rollup", _ROLLUP.format(t="o_state"))
def _(w):
    return state.match_rollup(w.state)


@query("match_report_rollup", _ROLLUP.format(t="whole_match"), {"whole_match": _WHOLE_MATCH})
def _(w):
    return pipelines.match_report(w.resumes, w.jd, w.alias, w.chunks, w.embed, dim=DIM)["rollup"]


@query("match_report_warnings", "SELECT resume_id, string_agg(w, '|' ORDER BY p, i) AS warnings FROM (SELECT resume_id, w, min(p) AS p, arg_min(i, p) AS i FROM (SELECT resume_id, CAST(replace(target_id, 'target_', '') AS INT) AS p, unnest(string_split(warnings, '|')) AS w, unnest(range(len(string_split(warnings, '|')))) AS i FROM whole_match WHERE warnings <> '') GROUP BY resume_id, w) GROUP BY resume_id", {"whole_match": _WHOLE_MATCH})
def _(w):
    found = pipelines.match_report(w.resumes, w.jd, w.alias, w.chunks, w.embed, dim=DIM)["warnings"]
    return found.select("resume_id", joined("warnings"))


@query("match_report_rejects", "SELECT resume_id, 'no_target_title' AS reason FROM fx_base WHERE resume_id NOT IN (SELECT resume_id FROM o_state)")
def _(w):
    return pipelines.match_report(w.resumes, w.jd, w.alias, w.chunks, w.embed, dim=DIM)["rejects"]


def _winner_sql(where: str) -> dict[str, str]:
    return {
        "winners": f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY resume_id, target_id ORDER BY ts, event_id) AS r FROM o_judged WHERE reason_code IS NULL AND {where}) WHERE r = 1",
        "after_review": """
SELECT s.resume_id, s.target_id, s.target_pos, s.requested_job_title, s.source, w.event_id AS winner,
  CASE w.action WHEN 'confirm' THEN 'resolved' WHEN 'reject' THEN 'needs_manual_resolution' ELSE s.status END AS status,
  CASE w.action WHEN 'confirm' THEN w.jd_id WHEN 'reject' THEN NULL ELSE s.selected_jd_id END AS selected_jd_id,
  CASE w.action WHEN 'confirm' THEN 'human_confirmed' ELSE s.resolution_method END AS resolution_method,
  CASE w.action WHEN 'reject' THEN 0 ELSE s.n_candidates END AS n_candidates,
  CASE w.action WHEN 'reject' THEN trim(w.reason) END AS rejection_reason,
  CASE w.action WHEN 'reject' THEN (SELECT string_agg(c.jd_id::VARCHAR, ',' ORDER BY c.jd_id) FROM o_exact_cands c
    WHERE c.resume_id = s.resume_id AND c.target_id = s.target_id) ELSE '' END AS rejected_jd_ids,
  array_to_string(list_filter([nullif(s.warning, ''), CASE w.action WHEN 'reject' THEN '人工已拒绝当前全部候选 JD，需要重新描述目标岗位' END], lambda v: v IS NOT NULL), '|') AS warnings
FROM o_state s LEFT JOIN winners w USING (resume_id, target_id)""",
    }


_REVIEWED = _STATE + ", rejection_reason, rejected_jd_ids, warnings"


def _reviewed(w, action: str) -> DataFrame:
    rows = w.after_review(action).join(w.rejected_ids(action), ["resume_id", "target_id"], "left").na.fill("", ["rejected_jd_ids"])
    return rows.select(*_STATE.split(", "), "rejection_reason", "rejected_jd_ids", joined("warnings"))


@query("confirm", f"SELECT {_REVIEWED} FROM after_review", _winner_sql("action = 'confirm'"))
def _(w):
    return _reviewed(w, "confirm")


@query("reject", f"SELECT {_REVIEWED} FROM after_review", _winner_sql("action = 'reject'"))
def _(w):
    return _reviewed(w, "reject")


@query("confirm_rejects", """
SELECT * FROM (SELECT j.event_id, j.resume_id, j.target_id, j.action,
  coalesce(j.reason_code, CASE WHEN j.event_id <> w.event_id THEN 'target_not_pending' END) AS reason_code
FROM o_judged j LEFT JOIN winners w USING (resume_id, target_id)) WHERE reason_code IS NOT NULL""", _winner_sql("TRUE"))
def _(w):
    return state.decision_rejects(w.judged, state.winning_decisions(w.judged)).select(
        "event_id", "resume_id", "target_id", "action", "reason_code")


@query("match_warnings", "SELECT resume_id, string_agg(w, '|' ORDER BY p, i) AS warnings FROM (SELECT resume_id, w, min(target_pos) AS p, arg_min(i, target_pos) AS i FROM (SELECT resume_id, target_pos, unnest(string_split(warnings, '|')) AS w, unnest(range(len(string_split(warnings, '|')))) AS i FROM after_review WHERE warnings <> '') GROUP BY resume_id, w) GROUP BY resume_id", _winner_sql("TRUE"))
def _(w):
    return state.match_warnings(w.after_review()).select("resume_id", joined("warnings"))


@query("check_match_state", """
SELECT * FROM (SELECT s.resume_id, s.target_id, s.status, s.sel AS selected_jd_id, CASE WHEN s.sel IS NOT NULL AND c.jd_id IS NULL THEN 'selected_not_a_candidate'
  WHEN s.status = 'resolved' AND s.sel IS NULL THEN 'resolved_without_selection'
  WHEN s.status = 'needs_confirmation' AND s.sel IS NOT NULL THEN 'pending_but_selected' END AS rule
FROM (SELECT *, CASE resume_id % 5 WHEN 0 THEN resume_id WHEN 1 THEN NULL ELSE selected_jd_id END AS sel FROM o_state) s
LEFT JOIN o_exact_cands c ON c.resume_id = s.resume_id AND c.target_id = s.target_id AND c.jd_id = s.sel) WHERE rule IS NOT NULL""")
def _(w):
    r = F.col("resume_id")
    broken = w.state.withColumn("selected_jd_id", F.when(r % 5 == 0, r).when(r % 5 != 1, F.col("selected_jd_id")))
    chosen = broken.withColumnRenamed("selected_jd_id", "jd_id")
    return state.check_match_state(broken, exact.listed_candidates(chosen, w.matches, w.jd))


_BINDINGS = """
SELECT resume_id, target_id, target_pos, requested_job_title, selected_jd_id, source, source <> 'exact' OR n_candidates > 1 AS human_confirmed,
  CASE WHEN all_resolved THEN 'complete' ELSE 'partial' END AS analysis_scope
FROM (SELECT *, bool_and(status = 'resolved') OVER (PARTITION BY resume_id) AS all_resolved FROM after_review) WHERE status = 'resolved'"""


@query("target_bindings", "SELECT * FROM bindings", {**_winner_sql("TRUE"), "bindings": _BINDINGS})
def _(w):
    return w.bindings


@query("agent_payload", """
SELECT resume_id, CASE WHEN pending = '' THEN 'ready' ELSE 'partially_ready' END AS match_status, CASE WHEN pending = '' THEN 'complete' ELSE 'partial' END AS analysis_scope,
  selected_targets, pending AS pending_target_ids
FROM (SELECT resume_id, string_agg(CASE WHEN status = 'resolved' THEN target_id || '=' || selected_jd_id || ' ' || resolution_method END, ',' ORDER BY target_pos) AS selected_targets,
  coalesce(string_agg(CASE WHEN status <> 'resolved' THEN target_id END, ',' ORDER BY target_pos), '') AS pending FROM after_review GROUP BY resume_id)
WHERE selected_targets IS NOT NULL""", _winner_sql("TRUE"))
def _(w):
    chosen = F.transform("selected_targets", lambda t: F.concat(
        t["target_id"], F.lit("="), t["selected_jd_id"].cast("string"), F.lit(" "), t["resolution_method"]))
    return state.agent_payloads(w.after_review()).select(
        "resume_id", "match_status", "analysis_scope", F.array_join(chosen, ",").alias("selected_targets"),
        joined("pending_target_ids", ","))


# ---- analysis inputs ------------------------------------------------------------------------------

_INPUT_CTES = {**_winner_sql("TRUE"), "bindings": _BINDINGS}


@query("analysis_inputs", """
SELECT p.resume_id, b.scope AS analysis_scope, array_to_string(list_filter(b.jds, lambda v, i: list_position(b.jds, v) = i), ',') AS jd_ids,
  b.targets AS target_ids, p.name AS candidate_name, p.n_name AS location,
  CASE WHEN p.has_education THEN p.school END AS school, CASE WHEN p.has_education THEN nullif(p.degree, '') END AS degree,
  CASE WHEN p.has_skills THEN array_to_string(""" + R._SKILLS + """, '|') ELSE '' END AS skills,
  p.n_work AS n_work, 'cert' AS certificates, p.c_name AS other_information
FROM fx_people p JOIN (SELECT resume_id, any_value(analysis_scope) AS scope, string_agg(target_id, ',' ORDER BY target_pos) AS targets,
    list(selected_jd_id ORDER BY target_pos) AS jds FROM bindings GROUP BY resume_id) b USING (resume_id)""", _INPUT_CTES)
def _(w):
    education = F.get(F.col("resume.educations"), F.lit(0))
    return w.inputs.select(
        "resume_id", "analysis_scope", F.array_join(F.col("matched_jds.jd_id").cast("array<string>"), ",").alias("jd_ids"),
        F.array_join("target_matches.target_id", ",").alias("target_ids"), F.col("resume.candidate_name").alias("candidate_name"),
        F.col("resume.location").alias("location"), education["school"].alias("school"), education["degree"].alias("degree"),
        F.array_join("resume.skills", "|").alias("skills"), F.size("resume.work_experiences").alias("n_work"),
        F.array_join("resume.certificates", "|").alias("certificates"),
        F.array_join("resume.other_information", "|").alias("other_information"),
    )


@query("analysis_input_rejects", "SELECT b.resume_id, b.target_id, b.selected_jd_id, CASE WHEN j.id IS NULL THEN 'jd_missing' ELSE 'missing_job_title' END AS reason FROM (SELECT * REPLACE (CASE WHEN resume_id % 9 = 0 THEN selected_jd_id + 900000000 ELSE selected_jd_id END AS selected_jd_id) FROM bindings) b LEFT JOIN fx_jd j ON j.id = b.selected_jd_id WHERE j.id IS NULL OR j.id % 13 = 0", _INPUT_CTES)
def _(w):
    moved = F.when(F.col("resume_id") % 9 == 0, F.col("selected_jd_id") + 900000000).otherwise(F.col("selected_jd_id"))
    blanked = w.jd.withColumn("job_title", F.when(F.col("id") % 13 == 0, " ").otherwise(F.col("job_title")))
    return assemble.input_rejects(w.bindings.withColumn("selected_jd_id", moved), assemble.jd_clean(blanked), w.resumes)


@query("jd_clean", f"""
SELECT id AS jd_id, {R.optional('job_title')} AS job_title, {R.optional('department')} AS department, {R.optional('work_experience_raw')} AS work_experience_raw,
  CASE WHEN has_lines THEN array_to_string({R.clean_list("string_split(text, chr(10))", R.strip)}, '|') ELSE '' END AS tasks,
  CASE WHEN has_lines THEN array_to_string({R.clean_list("string_split(text, '. ')", R.strip)}, '|') ELSE '' END AS competencies,
  CASE WHEN trim(job_title) = '' THEN 'missing_job_title' WHEN has_lines THEN 'responsibility_without_description' END AS problem
FROM fx_doc_jd""")
def _(w):
    first = F.get(F.col("jd.responsibilities"), F.lit(0))
    return assemble.jd_clean(w.doc_jd).select(
        "jd_id", "jd.job_title", "jd.department", "jd.qualification.work_experience_raw",
        F.coalesce(F.array_join(first["tasks"], "|"), F.lit("")).alias("tasks"),
        F.array_join("jd.qualification.competencies", "|").alias("competencies"), "problem")


@query("analysis_request_payload", "SELECT b.resume_id, b.selected_jd_id AS jd_id, count(*) AS n_bindings, j.job_title AS job_title, p.n_name AS location, string_agg(target_id, ',' ORDER BY target_pos) AS target_ids FROM bindings b JOIN fx_jd j ON j.id = b.selected_jd_id JOIN fx_people p ON p.resume_id = b.resume_id GROUP BY ALL", _INPUT_CTES)
def _(w):
    parsed = F.from_json("payload", "resume struct<location:string>, jd struct<job_title:string>, target_matches array<struct<target_id:string>>")
    return responses.analysis_requests(w.inputs).withColumn("p", parsed).select(
        "resume_id", "jd_id", "n_bindings", F.col("p.jd.job_title").alias("job_title"), F.col("p.resume.location").alias("location"),
        F.array_join("p.target_matches.target_id", ",").alias("target_ids"))


@query("analysis_jobs", "SELECT resume_id, selected_jd_id AS jd_id, min(target_pos) AS first_pos, count(*) AS target_count FROM bindings GROUP BY ALL", _INPUT_CTES)
def _(w):
    return runs.analysis_jobs(w.bindings)


@query("ref_integrity", """
SELECT DISTINCT resume_id, 'missing_jd' AS problem, jd::VARCHAR AS value FROM (SELECT l_orderkey AS resume_id, l_partkey AS jd FROM lineitem) b
WHERE NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_orderkey = b.resume_id AND s.l_suppkey % 3 <> 0 AND s.l_partkey = b.jd)
UNION ALL SELECT l_orderkey, 'duplicate_target', 'target_' || l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT l_orderkey, 'duplicate_jd', l_partkey::VARCHAR FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY l_orderkey, l_partkey HAVING count(*) > 1""")
def _(w):
    li = w.table("lineitem")
    bound = li.select(F.col("l_orderkey").alias("resume_id"),
                      F.concat(F.lit("target_"), F.col("l_linenumber").cast("string")).alias("target_id"),
                      F.col("l_partkey").alias("selected_jd_id"))
    listed = li.where(F.col("l_suppkey") % 3 != 0).select(F.col("l_orderkey").alias("resume_id"), F.col("l_partkey").alias("jd_id"))
    return assemble.reference_problems(bound, listed)


@query("binding_check", """
SELECT coalesce(e.resume_id, a.resume_id) AS resume_id, coalesce(e.target_id, a.target_id) AS target_id, expected_jd_id, actual_jd_id
FROM (SELECT resume_id, target_id, max(expected_jd_id) AS expected_jd_id FROM fx_bindings WHERE expected_jd_id IS NOT NULL GROUP BY ALL) e
FULL JOIN (SELECT resume_id, target_id, max(actual_jd_id) AS actual_jd_id FROM fx_bindings WHERE actual_jd_id IS NOT NULL GROUP BY ALL) a
ON e.resume_id = a.resume_id AND e.target_id = a.target_id WHERE expected_jd_id IS DISTINCT FROM actual_jd_id""")
def _(w):
    def side(name: str) -> DataFrame:
        return w.view("fx_bindings").where(F.col(name).isNotNull()).groupBy("resume_id", "target_id").agg(F.max(name).alias("jd_id"))

    return reports.check_bindings(side("expected_jd_id"), side("actual_jd_id"))


# ---- résumé quality -------------------------------------------------------------------------------


def _flag(condition: str, path: str, message: str, kind: str = "missing_field", severity: str = "warning", blocks: str = "FALSE") -> str:
    return f"SELECT resume_id, {path} AS field_path, '{kind}' AS issue_type, '{severity}' AS severity, '{message}' AS message, {blocks} AS blocks_analysis FROM fx_people WHERE {condition}"


_EDU, _WORKS = "'education_background.educations[0]", "'knowledge_and_experience.work_experiences["
_ISSUES = "\nUNION ALL ".join([
    _flag("NOT has_education AND NOT has_skills AND n_work = 0 AND n_project = 0", "'$'", "未提取到教育、技能、工作或项目经历，可能存在简历解析或LLM抽取失败", "low_quality", "error", "TRUE"),
    _flag("name IS NULL", "'basic_info.name'", "未提取到姓名"),
    _flag("phone IS NULL AND email IS NULL", "'basic_info'", "手机号和邮箱均为空"),
    _flag("target_job_title IS NULL", "'basic_info.target_job_title'", "未提取到目标岗位标题"),
    _flag("NOT has_education", "'education_background.educations'", "未提取到教育经历，可能影响学历条件判断", "empty_field"),
    _flag("has_education AND school IS NULL", _EDU + ".school'", "缺少学校名称"),
    _flag("has_education AND degree = ''", _EDU + ".degree'", "缺少学历或学位信息，可能影响JD硬条件判断"),
    _flag("has_education AND resume_id % 3 = 0", _EDU + ".evidence'", "教育经历缺少原始文本证据", "missing_evidence"),
    _flag("n_work >= 1 AND end_date_raw IS NULL", _WORKS + "0]'", "工作时间信息不完整，可能影响工作年限计算"),
    _flag("n_work = 2 AND end_date_raw IS NULL", _WORKS + "1]'", "工作时间信息不完整，可能影响工作年限计算"),
    _flag("n_work = 2 AND work_2_title IS NULL", _WORKS + "1].job_title'", "未提取到岗位名称"),
    _flag("n_project = 1 AND empty_project", "'knowledge_and_experience.project_experiences[0]'", "项目经历为空", "empty_field"),
])


@query("resume_issues", "SELECT * FROM issues", {"issues": _ISSUES})
def _(w):
    return quality.resume_issues(w.resumes).drop("current_value")


@query("resume_quality", "SELECT p.resume_id, count(i.message) AS issue_count, count_if(coalesce(i.blocks_analysis, FALSE)) AS blocking_count, CASE WHEN bool_or(coalesce(i.blocks_analysis, FALSE)) THEN 'review_required' WHEN count(i.message) > 0 THEN 'review_recommended' ELSE 'auto_approved' END AS quality_status, NOT bool_or(coalesce(i.blocks_analysis, FALSE)) AS can_analyze FROM fx_people p LEFT JOIN issues i USING (resume_id) GROUP BY p.resume_id", {"issues": _ISSUES})
def _(w):
    return quality.resume_quality(w.resumes)


_SCHEMA_JSON = """
SELECT resume_id, CASE resume_id % 6 WHEN 0 THEN '{"basic_info": {"name": 5, "other_links": "x"}}' WHEN 1 THEN '[1]'
  WHEN 2 THEN concat('{"schema_version": "', o_orderpriority, '", "knowledge_and_experience": {"skills": [{"skill": "a"}, {"level": 3}]}}')
  WHEN 3 THEN '{"basic_info": {"name": ' WHEN 4 THEN concat('{"schema_version": 1, "extra": 2, "basic_info": {"name": "', c_name, '"}}')
  ELSE '{"education_background": [], "other_info": {"languages": [{"language": null}], "awards": {"name": "x"}}}' END AS output_text
FROM fx_people"""


@query("resume_schema_errors", """
SELECT resume_id, unnest(paths) AS field_path, unnest(messages) AS message FROM (SELECT resume_id,
  CASE resume_id % 6 WHEN 0 THEN ['basic_info.name', 'basic_info.other_links'] WHEN 1 THEN ['$'] WHEN 2 THEN ['schema_version', 'knowledge_and_experience.skills[1].skill']
    WHEN 3 THEN ['$'] WHEN 5 THEN ['education_background', 'other_info.languages[0].language', 'other_info.awards'] ELSE [] END AS paths,
  CASE resume_id % 6 WHEN 0 THEN ['not_a_string', 'not_a_list'] WHEN 1 THEN ['not_an_object'] WHEN 2 THEN ['not_an_integer', 'missing']
    WHEN 3 THEN ['invalid_json'] WHEN 5 THEN ['not_an_object', 'missing', 'not_a_list'] ELSE [] END AS messages FROM fx_people)""")
def _(w):
    r = F.col("resume_id") % 6
    lit = F.lit
    text = (
        F.when(r == 0, '{"basic_info": {"name": 5, "other_links": "x"}}').when(r == 1, "[1]")
        .when(r == 2, F.concat(lit('{"schema_version": "'), "o_orderpriority", lit('", "knowledge_and_experience": {"skills": [{"skill": "a"}, {"level": 3}]}}')))
        .when(r == 3, '{"basic_info": {"name": ')
        .when(r == 4, F.concat(lit('{"schema_version": 1, "extra": 2, "basic_info": {"name": "'), "c_name", lit('"}}')))
        .otherwise('{"education_background": [], "other_info": {"languages": [{"language": null}], "awards": {"name": "x"}}}')
    )
    rows = w.view("fx_people").select("resume_id", text.alias("output_text"))
    return quality.schema_errors(rows, "output_text").select("resume_id", "field_path", "message")


# ---- reports --------------------------------------------------------------------------------------


@query("report_scores", "SELECT report_id, has_unknown, scored_dimensions, round(weighted_score, 6) AS weighted_score FROM o_weighted_reports")
def _(w):
    return reports.weighted_scores(w.assessments).withColumn("weighted_score", r6("weighted_score"))


@query("check_assessments", """
SELECT * FROM (SELECT report_id, dimension, CASE WHEN status IN ('unknown', 'not_applicable') AND score IS NOT NULL THEN 'score_must_be_null'
  WHEN status NOT IN ('unknown', 'not_applicable') AND score IS NULL THEN 'score_missing'
  WHEN status NOT IN ('unknown', 'not_applicable') AND NOT (list_contains(sources, 'jd') AND list_contains(sources, 'resume')) THEN 'must_cite_both_sources'
  WHEN status = 'unknown' AND n_missing = 0 THEN 'missing_information_needed' END AS rule FROM o_assess) WHERE rule IS NOT NULL""")
def _(w):
    return reports.check_assessments(w.assessments).select("report_id", "dimension", "rule")


@query("check_findings", "SELECT report_id, dimension, 'must_cite_both_sources' AS rule FROM o_assess WHERE NOT (list_contains(sources, 'jd') AND list_contains(sources, 'resume'))")
def _(w):
    return reports.check_findings(w.assessments.select("report_id", "dimension", "evidence")).select("report_id", "dimension", "rule")


@query("check_reports", """
SELECT report_id, rule FROM (SELECT r.report_id, unnest(list_filter([CASE WHEN r.target_a = r.target_b THEN 'duplicate_target' END,
  CASE WHEN o.overall_score IS NOT NULL AND o2.scored_dimensions = 0 THEN 'overall_without_dimensions' END, CASE WHEN r.n_questions < 1 THEN 'no_question' END], lambda v: v IS NOT NULL)) AS rule
FROM fx_reports r JOIN o_overall o USING (report_id) JOIN o_weighted_reports o2 USING (report_id))""")
def _(w):
    scores = w.assessments.groupBy("report_id").agg(F.collect_list(F.struct("dim", "score"))["score"].alias("dimension_scores"))
    rows = w.view("fx_reports").select("report_id", F.array("target_a", "target_b").alias("target_ids"), "n_questions").join(
        w.overall.select("report_id", "overall_score"), "report_id").join(scores, "report_id")
    return reports.check_reports(rows)


@query("check_outputs", """
SELECT resume_id, 'duplicate_jd' AS rule, jd_id::VARCHAR AS value FROM fx_reports GROUP BY resume_id, jd_id HAVING count(*) > 1
UNION ALL SELECT resume_id, 'duplicate_target', t FROM (SELECT resume_id, unnest([target_a, target_b]) AS t FROM fx_reports) GROUP BY resume_id, t HAVING count(*) > 1
UNION ALL SELECT DISTINCT resume_id, 'scope_differs', analysis_scope FROM fx_reports WHERE analysis_scope <> CASE WHEN resume_id % 7 = 0 THEN 'partial' ELSE 'complete' END""")
def _(w):
    rows = w.view("fx_reports").withColumn("target_ids", F.array("target_a", "target_b"))
    scope = F.when(F.col("resume_id") % 7 == 0, "partial").otherwise("complete")
    given = rows.select("resume_id").distinct().withColumn("analysis_scope", scope)
    return reports.check_outputs(rows, given)


@query("check_scoring", """
SELECT report_id, 'score_outside_band' AS rule, dimension AS detail FROM o_assess WHERE score IS NOT NULL AND NOT (
  (status = 'matched' AND score BETWEEN 80 AND 100) OR (status = 'partially_matched' AND score >= 40 AND score < 80) OR (status = 'mismatched' AND score >= 0 AND score < 40))
UNION ALL SELECT * FROM (SELECT report_id, CASE WHEN weighted_score IS NULL THEN CASE WHEN overall_score IS NOT NULL THEN 'overall_must_be_null' END
  WHEN overall_score IS NULL THEN 'overall_missing' WHEN abs(overall_score * 10 - round_even(overall_score * 10, 0)) > 1e-8 THEN 'overall_not_one_decimal'
  WHEN abs(overall_score - weighted_score) > 0.1 THEN 'overall_differs_from_weighted' END AS rule, 'overall' AS detail FROM o_overall) WHERE rule IS NOT NULL""")
def _(w):
    return reports.check_scoring(w.assessments, w.overall.select("report_id", "overall_score"))


# ---- runs -----------------------------------------------------------------------------------------


@query("attempt_fold", "SELECT resume_id, jd_id, status, attempts, attempts - 1 AS retry_count, attempts - CASE WHEN status = 'succeeded' THEN 1 ELSE 0 END AS error_count, last_event_id FROM o_fold")
def _(w):
    return w.folded.drop("last_ts")


@query("check_attempts", "SELECT a.resume_id, a.jd_id, a.event_id, 'attempt_after_end' AS rule FROM fx_attempts a JOIN o_fold f USING (resume_id, jd_id) WHERE f.status <> 'retry_pending' AND (a.ts, a.event_id) > (f.last_ts, f.last_event_id)")
def _(w):
    return runs.check_attempts(w.attempts, w.folded)


@query("check_job_states", """
SELECT resume_id, jd_id, CASE WHEN k IN (1, 5) THEN 'succeeded' WHEN k = 2 THEN 'pending' WHEN k IN (3, 6) THEN 'retry_pending' ELSE 'failed' END AS status,
  CASE k WHEN 1 THEN 'report_iff_succeeded' WHEN 2 THEN 'pending_with_history' WHEN 3 THEN 'error_count' WHEN 4 THEN 'attempt_numbers' WHEN 5 THEN 'report_of_other_jd'
    WHEN 6 THEN 'budget_spent' WHEN 7 THEN 'failed_with_budget' WHEN 8 THEN 'over_budget' ELSE 'run_after_final_error' END AS rule
FROM (SELECT DISTINCT resume_id, jd_id, resume_id % 10 AS k FROM fx_attempts) WHERE k > 0""")
def _(w):
    k, lit = F.col("resume_id") % 10, F.lit
    tries = F.when(k == 2, 1).when(k == 6, 2).when(k == 8, 3).when(k == 9, 1).otherwise(0)
    numbers = F.when(k == 4, F.array(lit(2))).when(k.isin(2, 7), F.array(lit(1))).when(k == 6, F.sequence(lit(1), lit(3))).when(
        k == 8, F.sequence(lit(1), lit(4))).when(k == 9, F.sequence(lit(1), lit(2))).otherwise(F.array().cast("array<int>"))
    errors = F.transform(numbers, lambda n: F.struct(n.alias("attempt_number"), ((k != 9) | (n > 1)).alias("retryable")))
    status = F.when(k.isin(0, 1, 5), "succeeded").when(k == 2, "pending").when(k.isin(3, 6), "retry_pending").otherwise("failed")
    jobs = w.view("fx_attempts").select("resume_id", "jd_id").distinct()
    return runs.check_job_states(jobs.select(
        "resume_id", "jd_id", status.alias("status"), k.isin(0, 5).alias("has_report"),
        (F.col("jd_id") + (k == 5).cast("int")).alias("report_jd_id"), tries.alias("retry_count"), errors.alias("errors")))


@query("check_job_states_unknown", """
SELECT resume_id, jd_id, status, CASE WHEN status IS NULL OR status = 'superb' THEN 'unknown_status' WHEN has_report IS NULL THEN 'report_iff_succeeded'
  WHEN tries IS NULL THEN 'error_count' WHEN retryable IS NULL THEN 'retry_of_final_error' END AS rule
FROM (SELECT DISTINCT resume_id, jd_id, CASE resume_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'superb' ELSE 'retry_pending' END AS status,
  CASE WHEN resume_id % 6 <> 2 THEN FALSE END AS has_report, CASE WHEN resume_id % 6 <> 3 THEN 0 END AS tries, CASE WHEN resume_id % 6 <> 4 THEN TRUE END AS retryable FROM fx_attempts)
WHERE status IS NULL OR status = 'superb' OR has_report IS NULL OR tries IS NULL OR retryable IS NULL""")
def _(w):
    k = F.col("resume_id") % 6
    error = F.struct(F.lit(1).alias("attempt_number"), F.when(k != 4, True).alias("retryable"))
    return runs.check_job_states(w.view("fx_attempts").select("resume_id", "jd_id").distinct().select(
        "resume_id", "jd_id", F.when(k == 1, "superb").when(k > 1, "retry_pending").alias("status"), F.when(k != 2, False).alias("has_report"),
        F.when(k != 3, 0).alias("retry_count"), F.array(error).alias("errors")))


@query("check_job_cover", """
SELECT coalesce(b.resume_id, j.resume_id) AS resume_id, coalesce(b.jd_id, j.jd_id) AS jd_id, CASE WHEN j.jd_id IS NULL THEN 'job_missing' ELSE 'job_not_bound' END AS rule
FROM (SELECT DISTINCT resume_id, expected_jd_id AS jd_id FROM fx_bindings WHERE expected_jd_id IS NOT NULL) b
FULL JOIN (SELECT DISTINCT resume_id, actual_jd_id AS jd_id FROM fx_bindings WHERE actual_jd_id IS NOT NULL) j ON b.resume_id = j.resume_id AND b.jd_id = j.jd_id
WHERE b.jd_id IS NULL OR j.jd_id IS NULL""")
def _(w):
    rows = w.view("fx_bindings")
    jobs = rows.where("actual_jd_id IS NOT NULL").select("resume_id", F.col("actual_jd_id").alias("jd_id"))
    return runs.check_job_cover(jobs, rows.where("expected_jd_id IS NOT NULL").withColumnRenamed("expected_jd_id", "selected_jd_id"))


@query("runnable_jobs", "SELECT resume_id, jd_id, status FROM o_fold WHERE status = 'retry_pending'")
def _(w):
    return runs.runnable_jobs(w.job_states).select("resume_id", "jd_id", "status")


_RUNS = """
SELECT *, CASE WHEN NOT finished THEN 'running' WHEN succeeded_count = job_count THEN 'succeeded' WHEN succeeded_count > 0 THEN 'partial_failed' ELSE 'failed' END AS run_status
FROM (SELECT resume_id, count(*) AS job_count, count_if(status = 'succeeded') AS succeeded_count, bool_and(status <> 'retry_pending') AS finished FROM o_fold GROUP BY resume_id)"""


@query("run_status", "SELECT * FROM runs", {"runs": _RUNS})
def _(w):
    return runs.run_status(w.job_states)


@query("retry_schedule", "SELECT resume_id, jd_id, delay AS delay_seconds, epoch_us(last_ts + to_microseconds((delay * 1000000)::BIGINT)) AS next_us FROM (SELECT *, greatest(least(30.0, pow(2, attempts - 1)), (resume_id % 40)::DOUBLE) AS delay FROM o_fold WHERE status = 'retry_pending')")
def _(w):
    hints = w.attempts.select("resume_id", "jd_id").distinct().withColumn("retry_after_seconds", (F.col("resume_id") % 40).cast("double"))
    rows = runs.retry_schedule(w.folded, hints)
    micros = F.unix_micros(F.to_timestamp(F.concat(F.date_format("next_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" UTC")), "yyyy-MM-dd HH:mm:ss.SSSSSS z"))
    return rows.select("resume_id", "jd_id", "delay_seconds", micros.alias("next_us"))


@query("final_outputs", "SELECT resume_id, string_agg(jd_id::VARCHAR, ',' ORDER BY jd_id) AS jd_ids FROM o_fold WHERE resume_id IN (SELECT resume_id FROM runs WHERE run_status = 'succeeded') GROUP BY resume_id", {"runs": _RUNS})
def _(w):
    done = runs.final_outputs(w.job_states, runs.run_status(w.job_states))
    return done.select("resume_id", F.array_join(F.col("job_analyses.jd_id").cast("array<string>"), ",").alias("jd_ids"))


def _analyzer(requests: DataFrame) -> DataFrame:
    """Stand-in for a service: how it answers depends on the job and on the attempt."""
    asked = F.from_json("payload", "resume struct<location:string>, jd struct<job_title:string>, target_matches array<struct<target_id:string>>")
    kind, again = (F.col("resume_id") * 3 + F.col("jd_id")) % 5, F.col("attempt")
    cite = F.array(
        F.struct(F.lit("resume").alias("source"), F.lit("/location").alias("path"), F.col("a.resume.location").alias("quote")),
        F.struct(F.lit("jd").alias("source"), F.lit("/job_title").alias("path"), F.col("a.jd.job_title").alias("quote")))
    texts = F.array().cast("array<string>")
    score = (F.lit(80) + F.col("jd_id") % 20).cast("double")
    dimension = F.struct(
        F.lit("matched").alias("status"), score.alias("score"), F.lit("r").alias("rationale"), cite.alias("evidence"), texts.alias("missing_information"))
    question = F.struct(
        F.lit("skills").alias("dimension"), F.lit("q").alias("question"), F.lit("p").alias("purpose"), cite.alias("evidence"), F.array(F.lit("e")).alias("evaluation_points"))
    report = F.struct(
        "jd_id", F.col("a.target_matches.target_id").alias("target_ids"), F.lit("s").alias("summary"), score.alias("overall_score"), F.lit("r").alias("overall_score_reason"),
        F.struct(*[dimension.alias(n) for n in DIMENSION_WEIGHTS]).alias("dimensions"),
        F.array().cast(REPORT["strengths"].dataType).alias("strengths"), F.array().cast(REPORT["gaps"].dataType).alias("gaps"),
        F.array(question).alias("interview_questions"))
    fails = (kind == 0) | ((kind == 1) & (again == 1)) | ((kind == 2) & (again < 3))
    return requests.withColumn("a", asked).select(
        "resume_id", "jd_id", again.cast("long").alias("event_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"),
        F.lit(1).alias("n_choices"), F.when(kind == 3, "no").alias("refusal"), F.lit("stop").alias("finish_reason"), F.lit(False).alias("has_tool_calls"),
        F.when(fails, F.when(kind == 2, F.lit("{")).otherwise(F.lit(" "))).otherwise(F.to_json(report)).alias("content"))


@query("analysis_to_end", """
SELECT resume_id, jd_id, status, attempts, attempts - 1 AS retry_count, attempts - (status = 'succeeded')::INT AS error_count, run_status, code,
  CASE WHEN run_status = 'succeeded' THEN 80 + jd_id % 20 END::DOUBLE AS reported_score
FROM (SELECT *, CASE WHEN bool_and(status = 'succeeded') OVER r THEN 'succeeded' WHEN bool_or(status = 'succeeded') OVER r THEN 'partial_failed' ELSE 'failed' END AS run_status
  FROM (SELECT resume_id, jd_id, CASE k WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS attempts, CASE WHEN k IN (0, 3) THEN 'failed' ELSE 'succeeded' END AS status,
    CASE k WHEN 0 THEN 'empty_output' WHEN 1 THEN 'empty_output' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'model_refusal' END AS code
    FROM (SELECT DISTINCT resume_id, selected_jd_id AS jd_id, (resume_id * 3 + selected_jd_id) % 5 AS k FROM bindings)) WINDOW r AS (PARTITION BY resume_id))""", _INPUT_CTES)
def _(w):
    bindings = materialize(w.bindings, "bindings")
    inputs = materialize(assemble.analysis_inputs(bindings, assemble.jd_clean(w.jd), w.resumes), "analysis-inputs")
    found = pipelines.analyze_to_end(inputs, bindings, _analyzer, f"{shared_folder(w.spark)}/attempts-{uuid.uuid4().hex}")
    reported = found["outputs"].select("resume_id", F.explode("job_analyses").alias("r")).select(
        "resume_id", F.col("r.jd_id").alias("jd_id"), F.col("r.report.overall_score").alias("reported_score"))
    codes = found["attempts"].groupBy("resume_id", "jd_id").agg(F.min("code").alias("code"))
    keys = ["resume_id", "jd_id"]
    return found["states"].join(found["run_status"].select("resume_id", "run_status"), "resume_id").join(reported, keys, "left").join(codes, keys).select(
        *keys, "status", "attempts", "retry_count", "error_count", "run_status", "code", "reported_score")


@query("results_by_date", "SELECT resume_id, run_date, n_resolved FROM (SELECT resume_id, '2024-01-0' || d AS run_date, count_if(status = 'resolved') AS n_resolved FROM o_state, range(1, 3) t(d) WHERE d = 1 OR resume_id % 2 = 0 GROUP BY ALL)")
def _(w):
    path = f"{shared_folder(w.spark)}/by-date-{uuid.uuid4().hex}"
    rows = materialize(w.state.groupBy("resume_id").agg(F.count_if(F.col("status") == "resolved").alias("n_resolved")), "by-resume")
    for date, part in (("2024-01-01", rows.limit(5)), ("2024-01-02", rows), ("2024-01-01", rows), ("2024-01-02", rows.where("resume_id % 2 = 0"))):
        tables.write_results(part, path, date)
    return w.spark.read.schema("resume_id bigint, n_resolved bigint, run_date string").json(path)
