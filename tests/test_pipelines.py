import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.functions.scorers import ModelScorer, NgramEmbedder, embed_texts, embed_units
from talentweave.operators import assemble, query_units, rerank, state
from talentweave.plans import pipelines
from talentweave.plans.storage import list_names, shared_folder
from talentweave.schemas import RESPONSIBILITY, RESUME
from talentweave.sources import intake, tables
from talentweave.streaming.decisions import current_winners, start_decisions, stream_rejects
from talentweave.streaming.intake import start_intake
from workload.queries import Work

JD = (f"id long, job_title string, department string, responsibilities array<{RESPONSIBILITY.simpleString()}>, minimum_education string, "
      "education_background string, work_experience_raw string, competencies array<string>")


def resumes(spark, *items):
    """Rows (resume_id, title, work title, duty, skill)."""
    basic = lambda title: (None, "1", "e", None, title, None, None, [])
    rows = [(i, 1, basic(title), ([],), ([(s, [])], [(None, w, None, None, None, [d], [], [])], []), ([], [], [], [], [], []))
            for i, title, w, d, s in items]
    return spark.createDataFrame(rows, T.StructType([T.StructField("resume_id", T.LongType()), *RESUME.fields]))


def jds(spark):
    return spark.createDataFrame([
        (1, "data engineer", "IT", [(1, "build spark pipelines", ["tune spark jobs"], None)], "bachelor", None, None, ["spark", "sql"]),
        (2, "cook", "Kitchen", [(1, "prepare meals", [], None)], None, None, None, ["knife skills"]),
        (3, "cook", "Canteen", [(1, "prepare large meals", [], None)], None, None, None, []),
    ], JD)


def chunks(spark, jd):
    text = F.concat_ws(" ", "job_title", F.array_join(F.col("responsibilities.description"), " "))
    rows = jd.select(F.col("id").alias("chunk_id"), F.col("id").alias("jd_id"), F.lit("duty").alias("chunk_type"),
                     F.lit(True).alias("is_embedding_target"), text.alias("text"))
    return embed_texts(rows, lambda: NgramEmbedder(256))


def test_match_with_the_bundled_models(spark):
    jd = jds(spark)
    people = resumes(spark, (1, "data engineer、spark pipelines data engineering", "engineer", "build spark pipelines", "spark"),
                     (2, "cook", "cook", "meals", "knife"), (3, None, "x", "y", "z"), (4, "chef", "cook", "meals", "knife"))
    alias = spark.createDataFrame([("chef", "cook")], "alias_title string, standard_title string")
    got = {(r.resume_id, r.target_id): r for r in pipelines.match_resumes(
        people, jd, alias, chunks(spark, jd), lambda u: embed_units(u, lambda: NgramEmbedder(256)), dim=256).collect()}
    assert (got[1, "target_1"].status, got[1, "target_1"].selected_jd_id) == ("resolved", 1)
    assert (got[1, "target_2"].status, got[1, "target_2"].source) == ("needs_confirmation", "semantic")
    assert got[2, "target_1"].n_candidates == got[4, "target_1"].n_candidates == 2
    assert not any(k[0] == 3 for k in got)


def test_rejected_candidates_do_not_come_back(spark):
    jd = jds(spark)
    people = resumes(spark, (1, "spark data engineering", "engineer", "build spark pipelines", "spark"))
    open_targets = spark.createDataFrame([(1, "target_1", 1, "spark data engineering")],
                                         "resume_id long, target_id string, target_pos int, requested_job_title string")
    embed = lambda u: embed_texts(u, lambda: NgramEmbedder(256))
    first = pipelines.semantic_match(open_targets, people, jd, chunks(spark, jd), embed, dim=256).first()
    assert first.recommended_jd_id == 1
    rejected = spark.createDataFrame([(1, "target_1", 1)], "resume_id long, target_id string, jd_id long")
    second = pipelines.semantic_match(open_targets, people, jd, chunks(spark, jd), embed, dim=256, rejected=rejected).first()
    assert 1 not in [c.jd_id for c in second.candidates]


def test_vectors_are_dropped_once_candidates_are_stored(spark):
    """The embedded units and the cells of chunks took most of the disk until the session ended."""
    jd, embed = jds(spark), lambda u: embed_units(u, lambda: NgramEmbedder(256))
    people = resumes(spark, (1, "spark engineer", "data engineer", "build spark pipelines", "spark"))
    targets = spark.createDataFrame([(1, "target_1", 1, "spark engineer")], "resume_id long, target_id string, target_pos int, requested_job_title string")
    before = set(list_names(spark, shared_folder(spark)))
    decided = pipelines.semantic_match(targets, people, jd, chunks(spark, jd), embed, dim=256)
    left = set(list_names(spark, shared_folder(spark))) - before
    assert not [name for name in left if name.startswith(("embedded-units", "chunk-cells"))]
    row = decided.first()
    assert row.recommended_jd_id == 1 and row.error is None


def test_only_recalled_jds_get_documents(spark):
    wide = "resume_id long, target_id string, "
    targets = spark.createDataFrame([(1, "target_1", "Dev"), (2, "target_1", "Dev")], wide + "requested_job_title string")
    found = spark.createDataFrame(
        [(1, "target_1", 3, "Dev"), (1, "target_1", 900, "Dev"), (2, "target_1", 3, "Dev"), (2, "target_1", None, "Dev")], wide + "jd_id long, requested_job_title string")
    jd = spark.range(500).select(F.col("id"), F.concat(F.lit("Dev "), "id").alias("job_title"))
    stored = list_names(spark, shared_folder(spark))
    work = Work(spark, "")
    work.__dict__ |= {"recalled": found, "titles": targets, "jd": _bare(jd)}
    assert [(r.jd_id, r.job_title) for r in work.documents.collect()] == [(3, "Dev 3")]
    assert {(r.resume_id, r.jd_id) for r in rerank.missing_documents(found, work.documents).collect()} == {(1, 900), (2, None)}
    new = [n for n in list_names(spark, shared_folder(spark)) if n not in stored]
    sizes = sorted(spark.read.parquet(f"{shared_folder(spark)}/{n}").count() for n in new)
    assert sizes == [1, 3]  # documents, and ids of recalled JDs


def _bare(jd):
    """JDs of an id and a title only."""
    none = {c: F.lit(None).cast("string") for c in ("department", "minimum_education", "education_background", "work_experience_raw")}
    kind = f"array<{RESPONSIBILITY.simpleString()}>"
    return jd.withColumns(none | {"responsibilities": F.lit(None).cast(kind), "competencies": F.lit(None).cast("array<string>")})


def test_a_failing_unit_touches_one_target_only(spark):
    jd = jds(spark)
    people = resumes(spark, (1, "spark person", "engineer", "build spark pipelines", "spark"), (2, "pipeline person", "engineer", "run spark", "s"),
                     (3, None, "x", "y", "z"))
    alias = spark.createDataFrame([], "alias_title string, standard_title string")

    def embed(units):
        made = embed_texts(units, lambda: NgramEmbedder(256))
        return made.withColumn("error", F.when(F.col("resume_id") == 1, "model out of memory"))

    def broken(units):
        made = embed_texts(units, lambda: NgramEmbedder(256))
        return made.withColumn("embedding", F.when((F.col("resume_id") == 2) & (F.col("query_order") == 1), F.lit(None)).otherwise(F.col("embedding")))

    for hook, hurt, text in ((embed, 1, "model out of memory"), (broken, 2, "missing")):
        out = pipelines.match_report(people, jd, alias, chunks(spark, jd), hook, dim=256)
        got = {r.resume_id: r for r in out["states"].collect()}
        assert got[hurt].warnings == [state.SEMANTIC_FAILED + text] and got[hurt].status == "no_candidate"
        assert got[3 - hurt].status == "needs_confirmation" and got[3 - hurt].n_candidates > 0
        assert [(r.resume_id, r.reason) for r in out["rejects"].collect()] == [(3, "no_target_title")]
        assert {r.resume_id: r.overall_status for r in out["rollup"].collect()} == {hurt: "blocked", 3 - hurt: "needs_confirmation"}
        assert {r.resume_id for r in out["warnings"].collect()} == {1, 2}


def test_intake_pipeline(spark):
    docs = intake.with_hash(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "doc_id long, text string"), "text")
    seen = docs.where("text = 'b'").select("document_hash")
    answers = F.when(F.col("text") == "a", F.lit(json.dumps({"schema_version": 1, "basic_info": {"name": "n"}}))).otherwise("{")
    got = pipelines.ingest_resumes(docs, seen, "doc_id", extract=lambda d: d.withColumn("output_text", answers))
    assert {(r.doc_id, r.ingest_status) for r in got.collect()} == {(1, "ok"), (4, "invalid_json")}
    quality = {r.quality_status for r in pipelines.judge_resumes(got).collect()}
    assert quality == {"review_required"}
    assert pipelines.ingest_resumes(docs, seen, "doc_id", extract=lambda d: d.withColumn("output_text", answers), force_refresh=True).count() == 3


def report(jd_id, targets, quote="build spark pipelines", overall=90.0, status="matched"):
    both = [{"source": "resume", "path": "/work_experiences/0/responsibilities/0", "quote": "spark"},
            {"source": "jd", "path": "/responsibilities/0/description", "quote": quote}]
    dim = {"status": status, "score": 90.0, "rationale": "r", "evidence": both, "missing_information": []}
    return json.dumps({
        "jd_id": jd_id, "target_ids": targets, "summary": "s", "overall_score": overall, "overall_score_reason": "r",
        "dimensions": {n: dim for n in ("education", "major", "experience", "skills", "responsibilities")},
        "strengths": [{"dimension": "skills", "description": "d", "evidence": both}], "gaps": [],
        "interview_questions": [{"dimension": "skills", "question": "q", "purpose": "p", "evidence": both, "evaluation_points": ["e"]}],
    })


def test_analysis_runs(spark):
    jd = jds(spark)
    people = resumes(spark, (1, "data engineer", "engineer", "build spark pipelines", "spark"), (2, "x", "engineer", "run spark", "s"))
    bindings = spark.createDataFrame(
        [(1, "target_1", 1, "data engineer", 1, "exact", "complete", False), (1, "target_2", 2, "de", 1, "semantic", "complete", True),
         (2, "target_1", 1, "x", 1, "semantic", "complete", True), (2, "target_2", 2, "y", 2, "semantic", "complete", True),
         (3, "target_1", 1, "x", 77, "semantic", "complete", True)],
        "resume_id long, target_id string, target_pos int, requested_job_title string, selected_jd_id long, source string, analysis_scope string, human_confirmed boolean")
    cleaned = assemble.jd_clean(jd)
    inputs = assemble.analysis_inputs(bindings, cleaned, people)
    assert {(r.resume_id, r.reason) for r in assemble.input_rejects(bindings, cleaned, people).collect()} == {(3, "jd_missing"), (3, "resume_missing")}
    assert "phone" not in json.dumps(json.loads(inputs.where("resume_id = 1").toJSON().first()))
    answers = [
        (1, 1, 1, report(1, ["target_1", "target_2"], quote="invented")), (1, 1, 2, report(1, ["target_2", "target_1"])),
        (1, 1, 3, report(1, ["target_1", "target_2"])),  # after the end
        (2, 1, 4, report(1, ["target_1"], overall=50.0)), (2, 1, 5, report(1, ["target_1"], status="unknown")), (2, 1, 6, report(1, ["target_9"])),
        (2, 2, 7, "{"),
    ]
    stored = spark.createDataFrame(answers, "resume_id long, jd_id long, event_id long, content string").selectExpr(
        "*", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "1 AS n_choices", "CAST(NULL AS STRING) AS refusal", "'stop' AS finish_reason", "false AS has_tool_calls")
    seen = []

    def analyze(requests):
        seen.append({(r.resume_id, r.jd_id, r.n_bindings) for r in requests.collect()})
        return stored

    out = pipelines.check_analysis_runs(inputs, bindings.where("resume_id < 3"), analyze)
    assert seen == [{(1, 1, 2), (2, 1, 1), (2, 2, 1)}]
    problems = {r.event_id: (r.succeeded, r.problem, r.code) for r in out["attempts"].collect()}
    assert problems == {
        1: (False, "evidence_not_found", "report_validation_failed"), 2: (True, None, None), 3: (True, None, None),
        4: (False, "overall_score", "report_validation_failed"), 5: (False, "assessment_rule", "report_validation_failed"),
        6: (False, "binding_differs", "report_validation_failed"), 7: (False, None, "invalid_json")}
    assert {r.resume_id: r.run_status for r in out["run_status"].collect()} == {1: "succeeded", 2: "running"}
    assert [r.event_id for r in out["late_attempts"].collect()] == [3]
    assert [(r.resume_id, len(r.job_analyses), r.job_analyses[0].report.overall_score) for r in out["outputs"].collect()] == [(1, 1, 90.0)]
    assert [(r.resume_id, r.jd_id, r.delay_seconds) for r in out["retries"].collect()] == [(2, 2, 1.0)]


def job_inputs(spark, n):
    jd = jds(spark)
    people = resumes(spark, *[(i, "x", "engineer", "build spark pipelines", "spark") for i in range(n)])
    rows = [(i, f"target_{k + 1}", k + 1, "x", (1, 2, 77)[k], "semantic", "complete", True) for i in range(n) for k in range(1 + (i % 4 > 0) + (i == 5))]
    bindings = spark.createDataFrame(
        rows, "resume_id long, target_id string, target_pos int, requested_job_title string, selected_jd_id long, source string, analysis_scope string, human_confirmed boolean")
    good = bindings.where("selected_jd_id < 3")
    return assemble.analysis_inputs(good, assemble.jd_clean(jd), people), bindings


class Service:
    """Answers jobs by a table of how often each fails first and how; counts what it was asked."""

    def __init__(self, spark, plan, break_in=None):
        self.spark, self.plan, self.break_in, self.asked = spark, plan, break_in, []

    def __call__(self, requests):
        if requests.isEmpty():
            jobs = []
        else:
            jobs = [(r.resume_id, r.jd_id, r.attempt) for r in requests.select("resume_id", "jd_id", "attempt").collect()]
            self.asked.append(sorted(jobs))
        if self.break_in == len(self.asked):
            raise RuntimeError("service went away")
        rows = []
        for r, j, attempt in jobs:
            fails, how = self.plan[r, j]
            text = {"{": "{", "refusal": "", "wrong": report(j, ["target_9"])}.get(how) if attempt <= fails else good_report(j)
            if not (attempt <= fails and how == "silence"):
                rows.append((r, j, attempt, text, "no" if attempt <= fails and how == "refusal" else None, "7.5" if how == "{" else None))
        rows.append((99, 1, 1, "{", None, None))  # of a job nobody asked for
        return self.spark.createDataFrame(
            rows, "resume_id long, jd_id long, event_id long, content string, refusal string, retry_after string").selectExpr(
            "*", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "1 AS n_choices", "'stop' AS finish_reason", "false AS has_tool_calls")


def good_report(jd_id):
    return report(jd_id, [f"target_{jd_id}"], quote={1: "build spark pipelines", 2: "prepare meals"}[jd_id])


def plain_run(plan, bindings, retries):
    """What a queue of jobs does, one job after the other."""
    out = {}
    for r, j in sorted(bindings):
        if (r, j) not in plan:
            out[r, j] = ("failed", 1)
            continue
        fails, how = plan[r, j]
        tries = 1
        while tries <= fails and how != "refusal" and tries <= retries:
            tries += 1
        out[r, j] = ("failed" if tries <= fails else "succeeded", tries)
    return out


def test_analysis_to_the_end_equals_a_plain_queue(spark, tmp_path):
    rng = random.Random(3)
    inputs, bindings = job_inputs(spark, 9)
    jobs = [(r.resume_id, r.selected_jd_id) for r in bindings.collect()]
    plan = {job: (rng.randint(0, 4), rng.choice(["{", "refusal", "wrong", "silence"])) for job in jobs if job[1] < 3}
    wanted, waits = plain_run(plan, jobs, 2), []
    service = Service(spark, plan)
    out = pipelines.analyze_to_end(inputs, bindings, service, str(tmp_path / "log"), wait=waits.append)
    assert {(r.resume_id, r.jd_id): (r.status, r.attempts) for r in out["states"].collect()} == wanted
    assert {s for s, _ in wanted.values()} == {"failed", "succeeded"} and len(service.asked) == 3
    for n, asked in enumerate(service.asked, 1):
        assert asked == sorted((*job, n) for job, (_, tries) in wanted.items() if tries >= n and job in plan)
    # A service that says how long to wait is not asked sooner; otherwise delays double.
    assert waits == [7.5 if any(plan[j][1] == "{" and wanted[j][1] > n for j in plan) else 2.0 ** (n - 1) for n in (1, 2)]
    done = {r for r in range(9) if all(s == "succeeded" for (i, _), (s, _) in wanted.items() if i == r)}
    reports = {r.resume_id: [a.report.jd_id for a in r.job_analyses] for r in out["outputs"].collect()}
    assert reports == {r: [j for i, j in sorted(wanted) if i == r] for r in done} and done
    codes = {r.code for r in out["attempts"].collect()}
    assert {"no_input", "no_response", "invalid_json", "model_refusal", "report_validation_failed"} <= codes
    # Once all jobs have ended nothing is asked again.
    again = Service(spark, plan)
    assert pipelines.analyze_to_end(inputs, bindings, again, str(tmp_path / "log"))["attempts"].count() == out["attempts"].count()
    assert again.asked == []


def test_a_broken_analysis_goes_on_where_it_broke(spark, tmp_path):
    inputs, bindings = job_inputs(spark, 3)
    plan = {(r.resume_id, r.selected_jd_id): (r.resume_id % 3, "{") for r in bindings.collect()}
    first = Service(spark, plan, break_in=2)
    with pytest.raises(RuntimeError):
        pipelines.analyze_to_end(inputs, bindings, first, str(tmp_path / "log"))
    second = Service(spark, plan)
    out = pipelines.analyze_to_end(inputs, bindings, second, str(tmp_path / "log"))
    assert second.asked[0] == first.asked[1] and len(second.asked) == 2
    assert {(r.resume_id, r.jd_id): (r.status, r.attempts) for r in out["states"].collect()} == plain_run(plan, list(plan), 2)
    nothing = pipelines.analyze_to_end(inputs.limit(0), bindings.limit(0), Service(spark, {}), str(tmp_path / "none"))
    assert nothing["states"].count() == nothing["outputs"].count() == 0


def test_a_failing_pair_touches_one_target_only(spark):
    jd = jds(spark)
    people = resumes(spark, (1, "spark person", "engineer", "build spark pipelines", "spark"), (2, "pipeline person", "engineer", "run spark", "s"),
                     (3, "meal person", "cook", "meals", "knife"))
    alias = spark.createDataFrame([], "alias_title string, standard_title string")

    def scores(word, answer):
        def score(pairs):
            if any(word in a for a, _ in pairs):
                if isinstance(answer, Exception):
                    raise answer
                return [answer if word in a else 0.5 for a, _ in pairs]
            return [0.5] * len(pairs)

        return ModelScorer(lambda: score, "test")

    embed = lambda u: embed_units(u, lambda: NgramEmbedder(256))

    def run(scorer):
        found = pipelines.match_resumes(people, jd, alias, chunks(spark, jd), embed, dim=256, scorer=scorer).collect()
        return {r.resume_id: r.asDict(recursive=True) for r in found}

    sound = run(scores("nothing", 0.5))
    for answer, told in ((ValueError("x"), "ValueError"), (7.0, "score_out_of_range"), (float("nan"), "score_out_of_range")):
        got = run(scores("pipeline person", answer))
        assert got[2]["status"] == "no_candidate" and got[2]["warnings"] == [state.SEMANTIC_FAILED + told]
        assert all(got[i] == sound[i] for i in (1, 3)) and sound[2]["status"] == "needs_confirmation"


def test_broken_units_are_counted_while_they_pass(spark):
    jd = jds(spark)
    people = resumes(spark, (1, "spark person", "engineer", "build spark pipelines", "spark"), (2, "pipeline person", "engineer", "run spark", "s"))
    targets = spark.createDataFrame([(i, "target_1", 1, t) for i, t in ((1, "spark person"), (2, "pipeline person"))],
                                    "resume_id long, target_id string, target_pos int, requested_job_title string")
    sound = lambda u: embed_units(u, lambda: NgramEmbedder(256))
    first = (F.col("resume_id") == 1) & (F.col("query_order") == 1)

    def blank(units):
        made = sound(units).withColumn("text", F.when(first, F.lit(" ")).otherwise(F.col("text")))
        return made.withColumn("weight", F.when(F.col("resume_id") == 2, F.lit(float("nan"))).otherwise(F.col("weight")))

    def run(embed, **options):
        notes = {}
        pipelines.semantic_match(targets, people, jd, chunks(spark, jd), embed, dim=256, notes=notes, **options)
        return notes

    units = query_units.explode_units(query_units.unit_arrays(targets, people))
    of_two = units.where("resume_id = 2").count()
    assert run(sound, strict_input=True) == {}
    assert run(blank) == {"blank_text": 1, "bad_weight": of_two}
    assert run(lambda u: sound(u).where(~first)) == {"units_lost": 1}
    with pytest.raises(ValueError, match="units_added"):
        run(lambda u: sound(u).unionByName(sound(u).where(first)), strict_input=True)


def test_results_are_filed_by_run_date(spark, tmp_path):
    tables.write_results(spark.createDataFrame([(1, ["w"])], "resume_id long, warnings array<string>"), str(tmp_path / "out"), "2024-01-02")
    got = spark.read.json(str(tmp_path / "out")).first()
    assert (got.resume_id, got.warnings, str(got.run_date)) == (1, ["w"], "2024-01-02")


def test_streamed_intake_equals_batch(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))).select("doc_id", "text", "ts")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        start_intake(stream, "text", "ts", str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    stored = spark.read.parquet(str(tmp_path / "out"))
    wanted = intake.with_hash(docs, "text").select("document_hash").distinct()
    assert stored.count() == wanted.count() == stored.select("document_hash").distinct().count()
    # a fresh checkpoint replays every document; the anti join keeps what is stored
    start_intake(stream, "text", "ts", str(tmp_path / "out2"), str(tmp_path / "ckpt2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out2")).select("document_hash").exceptAll(stored.select("document_hash")).count() == 0


def test_streamed_decisions_equal_batch(spark, tables, tmp_path):
    w = Work(spark, tables)
    events = w.view("fx_decisions")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    known = state_table(w.state, tmp_path / "state")
    listed = state_table(w.exact_candidates, tmp_path / "cands")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start_decisions(stream, known, listed, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(180)
    batch = state.winning_decisions(state.judged_decisions(known, listed, events))
    got = current_winners(spark, str(tmp_path / "out"))
    assert batch.count() > 0
    assert got.select(batch.columns).exceptAll(batch).count() == batch.exceptAll(got.select(batch.columns)).count() == 0
    lost = state.decision_rejects(state.judged_decisions(known, listed, events), batch).select("event_id", "reason_code")
    streamed = stream_rejects(spark, str(tmp_path / "out")).select("event_id", "reason_code")
    assert lost.count() > 0 and streamed.exceptAll(lost).count() == lost.exceptAll(streamed).count() == 0
    versions = spark.read.parquet(str(tmp_path / "out" / "winners")).select("bucket", "batch_id").distinct().groupBy("bucket").count()
    assert versions.where("count > 2").count() == 0


def state_table(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))
