"""Whole runs, composed of the operators. Model calls are hooks given by the user."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.config import (
    DIMENSION_WEIGHTS, TARGET_KEYS, TITLE_SUFFIXES, PassageConfig, QueryConfig, RecallConfig, RerankConfig, RetryConfig,
)
from talentweave.functions import pointers, strict
from talentweave.functions import text as X
from talentweave.functions import vectors as V
from talentweave.functions.rows import explode_rows
from talentweave.functions.scorers import SCORE_ERROR, JaccardScorer
from talentweave.operators import (
    assemble, exact, intents, passages, quality, query_units, recall, reports, rerank, runs, similarity, state,
)
from talentweave.plans.storage import drop_tables, exists, materialize, noted_tables
from talentweave.schemas import REPORT, RESUME
from talentweave.sources import intake, responses
from talentweave.sources.store import ResultStore

Hook = Callable[[DataFrame], DataFrame]


def recall_targets(
    queries: DataFrame, chunks: DataFrame, *, dim: int, cfg: RecallConfig = RecallConfig(),
    chunk_types: list[str] | None = None, units: DataFrame | None = None, rejected: DataFrame | None = None,
) -> DataFrame:
    """Ranked JD candidates of every target from its embedded queries, without those ``rejected`` (resume_id, target_id, jd_id).

    ``units`` are the same queries before they were embedded, where that is cheaper to read.
    """
    weighted = recall.with_effective_weights(queries.drop("embedding") if units is None else units, cfg)
    hits = similarity.nearest_chunks(queries, chunks, top_k=cfg.top_k, dim=dim, chunk_types=chunk_types, rejected=rejected, as_lists=True)
    evidence = recall.query_evidence(recall.best_chunk_per_query(hits, cfg), weighted)
    return recall.ranked_candidates(recall.recall_candidates(evidence, cfg), cfg.top_n)


def rerank_targets(
    targets: DataFrame, recalled: DataFrame, queries: DataFrame, jd: DataFrame, *, scorer=None,
    cfg: RerankConfig = RerankConfig(), passage_cfg: PassageConfig = PassageConfig(),
) -> DataFrame:
    """Decision per target from its recalled JDs; ``recalled`` is read several times, so pass a stored table.

    With a scorer that may fail rows have ``error``; a target with a pair that has no score gets no candidates, other targets are not touched.
    """
    scorer = scorer or JaccardScorer()
    documents = materialize(passages.jd_documents(rerank.recalled_jds(jd, recalled), passage_cfg), "jd-documents")
    titles = rerank.title_scores(recalled, documents, scorer)
    pairs = rerank.support_pairs(recalled, queries, documents, cfg, scorer=scorer)
    best = rerank.best_scores(rerank.score_pairs(pairs, scorer))
    failed = None
    if SCORE_ERROR in titles.columns:
        titles, best = materialize(titles, "title-scores"), materialize(best, "support-scores")  # a model scores each pair once
        failed = materialize(rerank.scoring_errors(titles, best), "scoring-errors")
        titles, best = (s.drop(SCORE_ERROR).join(failed, TARGET_KEYS, "left_anti") for s in (titles, best))
    types = rerank.support_type_scores(best, cfg)
    ranked = rerank.ranked_rerank(rerank.rerank_candidates(titles, types, cfg), cfg)
    missing = rerank.missing_documents(recalled, documents)
    decided = rerank.rerank_decision(targets, recalled, missing, ranked, cfg)
    return decided if failed is None else decided.join(failed, TARGET_KEYS, "left")


def semantic_match(
    targets: DataFrame, resumes: DataFrame, jd: DataFrame, chunks: DataFrame, embed: Hook, *, dim: int, scorer=None,
    rejected: DataFrame | None = None, query_cfg: QueryConfig = QueryConfig(), recall_cfg: RecallConfig = RecallConfig(),
    rerank_cfg: RerankConfig = RerankConfig(), passage_cfg: PassageConfig = PassageConfig(), strict_input: bool = False,
    notes: dict[str, int] | None = None,
) -> DataFrame:
    """One decision row per open target, with its kept candidates and the warnings of both stages.

    ``embed`` adds ``embedding`` to the query units, and may add ``error`` where it failed. ``rejected`` (resume_id,
    target_id, jd_id) keeps JDs a person has turned down from coming back. A unit that failed, or whose vector is unusable,
    or a pair that got no score gives its target the column ``error`` and no candidates; other targets are not touched.

    Units are counted while they pass: ``notes`` gets how many break a rule, by reason (``recall.unit_problems``), and how many
    ``embed`` lost or added (``units_lost``, ``units_added``); with ``strict_input`` such units end the run with a ValueError.
    """
    arrays = materialize(query_units.unit_arrays(targets, resumes, query_cfg), "query-units")
    units = query_units.explode_units(arrays)
    embedded = embed(units)
    told = F.col("error") if "error" in embedded.columns else F.lit(None).cast("string")
    counted, seen = recall.observed_units(
        embedded.withColumn("error", F.coalesce(told, V.vector_problem(F.col("embedding"), dim))), recall_cfg)
    # Texts stay in ``units``; what is stored here is what the search and the errors need.
    scratch: list[str] = []
    with noted_tables(scratch):
        embedded = materialize(counted.select(*similarity.QUERY_KEYS, "query_order", "embedding", "error"), "embedded-units")
    found = dict(seen.get)
    change = found.pop("rows") - units.count()
    found |= {"units_lost": max(0, -change), "units_added": max(0, change)}
    broken = {reason: n for reason, n in found.items() if n}
    if notes is not None:
        notes.update(broken)
    if broken and strict_input:
        raise ValueError(f"query units break rules: {broken}")
    # Stored, its size is known: where few targets failed, no vector moves to meet them.
    failed = materialize(embedded.where(F.col("error").isNotNull()).groupBy(*TARGET_KEYS).agg(
        F.min(F.struct("query_order", "error"))["error"].alias("error")), "failed-targets")
    queries = embedded.drop("error").join(failed, TARGET_KEYS, "left_anti")
    with noted_tables(scratch):
        ranked = recall_targets(queries, chunks, dim=dim, cfg=recall_cfg, units=units, rejected=rejected)
    recalled = materialize(
        ranked.join(arrays.select(*TARGET_KEYS, F.col("clean_title").alias("requested_job_title")), TARGET_KEYS), "recalled")
    drop_tables(targets.sparkSession, scratch)  # vectors and cells; what follows reads the candidates
    heads = arrays.select(*targets.columns, F.col("warnings").alias("build_warnings"))
    decided = rerank_targets(
        heads, recalled, units, jd, scorer=scorer, cfg=rerank_cfg, passage_cfg=passage_cfg
    )
    told = decided.withColumn("warnings", F.array_distinct(F.concat("build_warnings", "decision_warnings")))
    if "error" not in told.columns:
        return told.join(failed, TARGET_KEYS, "left")
    both = told.withColumnRenamed("error", "_score_error").join(failed, TARGET_KEYS, "left")
    return both.withColumn("error", F.coalesce("error", "_score_error")).drop("_score_error")


def match_resumes(
    resumes: DataFrame, jd: DataFrame, alias: DataFrame, chunks: DataFrame, embed: Hook, *, dim: int,
    suffixes: tuple[str, ...] = TITLE_SUFFIXES, **semantic,
) -> DataFrame:
    """State of every target of every résumé: exact, alias, else semantic."""
    wanted = intents.normalize_intents(
        resumes.select("resume_id", F.col("basic_info.target_job_title").alias("target_job_title")), suffixes=suffixes
    )
    matches = exact.exact_match(intents.explode_targets(wanted), jd, alias)
    open_targets = exact.unresolved(matches).select(*TARGET_KEYS, "target_pos", "requested_job_title")
    decisions = semantic_match(open_targets, resumes, jd, chunks, embed, dim=dim, **semantic)
    return state.with_semantic(state.exact_state(matches), decisions)


def match_report(
    resumes: DataFrame, jd: DataFrame, alias: DataFrame, chunks: DataFrame, embed: Hook, *, dim: int,
    inherited_warnings: DataFrame | None = None, **options,
) -> dict[str, DataFrame]:
    """A whole match result: ``states`` per target, ``rollup`` and ``warnings`` per résumé, and ``rejects``.

    ``rejects`` lists the résumés without any position to match, with the reason; they have no state. Targets whose
    semantic step failed are states with a warning.
    """
    states = materialize(match_resumes(resumes, jd, alias, chunks, embed, dim=dim, **options), "match-states")
    return {
        "states": states,
        "rollup": state.match_rollup(states),
        "warnings": state.match_warnings(states, inherited_warnings),
        "rejects": resumes.select("resume_id").join(states, "resume_id", "left_anti").withColumn("reason", F.lit("no_target_title")),
    }


def ingest_resumes(
    documents: DataFrame, processed: DataFrame, order: str, *, parse: Hook | None = None, extract: Hook | None = None,
    json_column: str = "output_text", schema: T.StructType = RESUME, force_refresh: bool = False,
) -> DataFrame:
    """New documents through the user's parser and extractor, then parsed and judged.

    The result has ``ingest_status`` and ``record`` per document; quality follows with ``judge_resumes``.
    """
    fresh = intake.new_documents(documents, processed, order, force_refresh)
    parsed = parse(fresh) if parse else fresh
    extracted = extract(parsed) if extract else parsed
    return intake.ingest_json(extracted, json_column, schema)


def process_documents(
    documents: DataFrame, store: ResultStore, order: str, *, parse: Hook | None = None, extract: Hook | None = None,
    json_column: str = "output_text", schema: T.StructType = RESUME, required: list[str] | None = None, force_refresh: bool = False,
) -> DataFrame:
    """Every distinct document with its record: a stored one, or else a new one, which is then stored.

    Rows have ``order``, ``document_hash``, ``ingest_status``, ``record``, ``schema_errors`` and ``from_cache``. Only good
    records are stored, so a document that failed is tried again by the next run; ``force_refresh`` computes all anew and replaces what is
    stored. The hooks run once for each document that is computed.
    """
    once = materialize(intake.distinct_documents(documents, order), "distinct-documents")
    stored = None if force_refresh else store.find(once)
    if stored is not None:
        stored = materialize(stored, "stored-records")
    fresh = once if stored is None else once.join(stored.select("document_hash"), "document_hash", "left_anti")
    extracted = (extract or _as_is)((parse or _as_is)(fresh))
    columns = [order, "document_hash", "ingest_status", "record", "schema_errors"]
    ingested = materialize(intake.ingest_json(extracted, json_column, schema, required).select(*columns), "ingested")
    store.save(ingested.where(F.col("ingest_status") == "ok").select("document_hash", "record"), replace=force_refresh)
    computed = ingested.withColumn("from_cache", F.lit(False))
    if stored is None:
        return computed
    known = once.select(order, "document_hash").join(stored, "document_hash").select(
        order, "document_hash", F.lit("ok").alias("ingest_status"), "record", strict.none().alias("schema_errors"), F.lit(True).alias("from_cache"))
    return known.unionByName(computed)


def _as_is(rows: DataFrame) -> DataFrame:
    return rows


def judge_resumes(ingested: DataFrame, key: str = "document_hash") -> DataFrame:
    """Quality per ingested résumé; a record that did not parse or breaks the schema needs review and cannot be analysed."""
    good = ingested.where(F.col("ingest_status") == "ok").select(F.col(key).alias("resume_id"), "record.*")
    bad = ingested.where(F.col("ingest_status") != "ok").select(
        F.col(key).alias("resume_id"), F.greatest(F.lit(1), F.size("schema_errors")).alias("issue_count"),
        F.greatest(F.lit(1), F.size("schema_errors")).alias("blocking_count"),
        F.lit("review_required").alias("quality_status"), F.lit(False).alias("can_analyze"),
    )
    return quality.resume_quality(good).unionByName(bad)


def report_problem(bound_ids: Column, resume_text: Column, jd_text: Column) -> Column:
    """First rule that the nested ``report`` of a row breaks, judged inside the row."""
    report = F.col("report")
    dims = {n: report["dimensions"][n] for n in DIMENSION_WEIGHTS}
    silent = {n: a["status"].isin("unknown", "not_applicable") for n, a in dims.items()}
    scored = {n: a["score"].isNotNull() for n, a in dims.items()}

    def any_of(conditions) -> Column:
        out = F.lit(False)
        for c in conditions:
            out = out | F.coalesce(c, F.lit(True))
        return out

    bad_assessment = any_of(
        (silent[n] & scored[n]) | (~silent[n] & (~scored[n] | ~reports.cites_both(a["evidence"])))
        | ((a["status"] == "unknown") & (F.size(a["missing_information"]) <= 0))
        for n, a in dims.items()
    )
    outside = any_of(scored[n] & ~F.coalesce(reports.in_band(a["status"], a["score"]), F.lit(False)) for n, a in dims.items())
    total = sum((F.when(scored[n], F.lit(float(w))).otherwise(F.lit(0.0)) for n, w in DIMENSION_WEIGHTS.items()), F.lit(0.0))
    points = sum(
        (F.coalesce(dims[n]["score"], F.lit(0.0)) * float(w) for n, w in DIMENSION_WEIGHTS.items()), F.lit(0.0)
    )
    unknown = any_of(a["status"] == "unknown" for a in dims.values())
    wanted = F.when(~unknown, F.try_divide(points, total))
    overall = report["overall_score"]
    bad_overall = F.when(wanted.isNull(), overall.isNotNull()).otherwise(
        overall.isNull() | (F.abs(overall * 10 - F.rint(overall * 10)) > 1e-8) | (F.abs(overall - wanted) > 0.1)
    )
    findings = F.concat(report["strengths"], report["gaps"])
    evidence = F.concat(
        *[a["evidence"] for a in dims.values()],
        F.flatten(F.transform(findings, lambda x: x["evidence"])),
        F.flatten(F.transform(report["interview_questions"], lambda x: x["evidence"])),
    )

    def unproven(e: Column) -> Column:
        leaf = F.when(e["source"] == "resume", F.try_element_at(resume_text, e["path"])).when(
            e["source"] == "jd", F.try_element_at(jd_text, e["path"])
        )
        return pointers.pointer_problem(e["path"], leaf).isNotNull() | X.is_blank(e["quote"]) | ~F.contains(leaf, e["quote"])

    rules = {
        "binding_differs": F.array_sort(report["target_ids"]) != F.array_sort(bound_ids),
        "duplicate_target": F.size(F.array_distinct(report["target_ids"])) != F.size(report["target_ids"]),
        "other_jd": report["jd_id"] != F.col("jd_id"),
        "assessment_rule": bad_assessment,
        "finding_sources": F.exists(findings, lambda x: ~reports.cites_both(x["evidence"])),
        "no_question": F.size(report["interview_questions"]) < 1,
        "score_outside_band": outside,
        "overall_score": bad_overall,
        "evidence_not_found": F.exists(evidence, lambda e: F.coalesce(unproven(e), F.lit(True))),
    }
    # A rule that can't be decided counts as broken.
    problem = F.lit(None).cast("string")
    for name, broken in reversed(rules.items()):
        problem = F.when(F.coalesce(broken, F.lit(True)), name).otherwise(problem)
    return problem


def judge_responses(stored: DataFrame, inputs: DataFrame) -> DataFrame:
    """Stored model responses as attempt-log rows.

    ``stored``: resume_id, jd_id, event_id, ts and the response columns of ``triage_responses``, and where the service says
    how long to wait also retry_after, the text of that header. The
    inputs are joined once per response; all rules are then checked inside the row.
    """
    jd_type = inputs.schema["matched_jds"].dataType.elementType
    own = inputs.select(
        "resume_id", pointers.text_leaves(F.col("resume"), inputs.schema["resume"].dataType).alias("resume_text"),
        "target_matches", "matched_jds",
    )
    own = explode_rows(own, ["resume_id", "resume_text", "target_matches"], "matched_jds", "jd").select(
        "resume_id", F.col("jd.jd_id").alias("jd_id"), "resume_text",
        pointers.text_leaves(F.col("jd"), jd_type).alias("jd_text"),
        F.transform(F.filter("target_matches", lambda t: t["selected_jd_id"] == F.col("jd.jd_id")), lambda t: t["target_id"])
        .alias("bound_ids"),
    )
    rows = responses.triage_responses(stored, REPORT, closed=True).join(own, runs.JOB_KEYS, "left").withColumn(
        "report", F.when(F.col("code").isNull(), F.from_json("content", REPORT))
    )
    problem = F.when(F.col("code").isNull() & F.col("bound_ids").isNull(), "not_bound").when(
        F.col("code").isNull(), report_problem(F.col("bound_ids"), F.col("resume_text"), F.col("jd_text"))
    )
    judged = rows.withColumn("problem", problem)
    said = [X.retry_after(F.col("retry_after")).alias("retry_after_seconds")] if "retry_after" in stored.columns else []
    failed_check = F.col("problem").isNotNull()
    return judged.select(
        *runs.JOB_KEYS, "event_id", "ts",
        (F.col("code").isNull() & ~failed_check).alias("succeeded"),
        F.when(failed_check, F.col("problem") != "not_bound").otherwise(F.coalesce("retryable", F.lit(True))).alias("retryable"),
        F.when(failed_check, "output_validate").otherwise(F.col("stage")).alias("stage"),
        F.when(failed_check, "report_validation_failed").otherwise(F.col("code")).alias("code"),
        "problem", F.when(~failed_check, F.col("report")).alias("report"), *said,
    )


def check_analysis_runs(
    inputs: DataFrame, bindings: DataFrame, analyze: Hook, cfg: RetryConfig = RetryConfig()
) -> dict[str, DataFrame]:
    """Requests to the user's analyzer, its responses judged, attempts folded, runs rolled up."""
    requests = responses.analysis_requests(inputs)
    attempts = materialize(judge_responses(analyze(requests), inputs), "attempts")
    return _outcome(attempts, runs.analysis_jobs(bindings), cfg)


def _outcome(attempts: DataFrame, jobs: DataFrame, cfg: RetryConfig) -> dict[str, DataFrame]:
    """What a stored attempt log comes to."""
    folded = runs.attempt_fold(attempts, cfg)
    states = runs.job_states(jobs, folded)
    status = runs.run_status(states)
    last = [*runs.JOB_KEYS, "last_event_id"]
    won = attempts.where("succeeded").select(*runs.JOB_KEYS, F.col("event_id").alias("last_event_id"), "report")
    done = folded.where(F.col("status") == "succeeded").select(*last)
    kept = won.join(done, last).drop("last_event_id")
    hints = None
    if "retry_after_seconds" in attempts.columns:
        said = attempts.select(*runs.JOB_KEYS, F.col("event_id").alias("last_event_id"), "retry_after_seconds")
        hints = said.join(folded.select(*last), last).drop("last_event_id")
    return {
        "attempts": attempts, "states": states, "run_status": status,
        "outputs": runs.final_outputs(states, status, kept),
        "late_attempts": runs.check_attempts(attempts, folded),
        "retries": runs.retry_schedule(folded, hints, cfg),
    }


def analyze_to_end(
    inputs: DataFrame, bindings: DataFrame, analyze: Hook, log: str, cfg: RetryConfig = RetryConfig(),
    wait: Callable[[float], None] | None = None,
) -> dict[str, DataFrame]:
    """Ask the user's analyzer for all jobs, then again for those that may be retried, until every job has ended.

    ``analyze`` gets resume_id, jd_id, n_bindings, payload and ``attempt`` of the jobs of a round and returns stored responses. Each round is a
    folder below ``log``; only a round that was written as a whole counts, so a run that broke goes on after its last whole round when it
    is started again. A job that gets no response has an attempt that may be retried (``no_response``), one without input
    fails for good (``no_input``); responses of jobs that were not asked for are left out. There are at most ``cfg.max_retries + 1`` rounds.
    ``wait`` is called between rounds with the longest delay of a job that waits, in seconds. The result is that of ``check_analysis_runs``.
    """
    spark = inputs.sparkSession
    jobs = materialize(runs.analysis_jobs(bindings), "analysis-jobs")
    requests = materialize(responses.analysis_requests(inputs), "analysis-requests")
    done = 0
    while exists(spark, f"{log}/round={done + 1}/_SUCCESS"):
        done += 1
    while True:
        outcome = _outcome(_attempt_log(spark, log, done), jobs, cfg) if done else None
        states = jobs.withColumns({"status": F.lit("pending"), "attempts": F.lit(None).cast("long")}) if outcome is None else outcome["states"]
        todo = materialize(runs.runnable_jobs(states).select(
            *runs.JOB_KEYS, (F.coalesce("attempts", F.lit(0)) + 1).cast("int").alias("attempt")), "runnable-jobs")
        if done > cfg.max_retries or todo.isEmpty():
            break
        if outcome is not None and wait is not None:
            wait(outcome["retries"].agg(F.max("delay_seconds")).first()[0] or 0.0)
        done += 1
        asked = requests.join(todo, runs.JOB_KEYS)
        judged = materialize(judge_responses(analyze(asked).join(todo.select(*runs.JOB_KEYS), runs.JOB_KEYS, "left_semi"), inputs), "judged")
        silent = todo.join(judged.select(*runs.JOB_KEYS).distinct(), runs.JOB_KEYS, "left_anti").join(
            requests.select(*runs.JOB_KEYS, F.lit(True).alias("_asked")), runs.JOB_KEYS, "left")
        code = F.when(F.col("_asked"), "no_response").otherwise("no_input")
        made = {
            "event_id": F.lit(-done), "ts": F.localtimestamp(), "succeeded": F.lit(False), "retryable": code == "no_response",
            "stage": F.lit("llm_call"), "code": code}
        missing = silent.select(*[
            c if c in runs.JOB_KEYS else made.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in judged.dtypes])
        judged.unionByName(missing).write.mode("overwrite").parquet(f"{log}/round={done}")
    if outcome is None:
        none = judge_responses(analyze(requests.withColumn("attempt", F.lit(1)).limit(0)), inputs)
        outcome = _outcome(materialize(none, "attempts"), jobs, cfg)
    return outcome


def _attempt_log(spark: SparkSession, log: str, rounds: int) -> DataFrame:
    folders = [f"{log}/round={n}" for n in range(1, rounds + 1)]
    return spark.read.option("basePath", log).parquet(*folders)
