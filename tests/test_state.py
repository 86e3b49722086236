import random

import pytest
from pyspark.sql import functions as F

from talentweave.config import RetryConfig
from talentweave.operators import runs, state

STATE = ("resume_id long, target_id string, target_pos int, requested_job_title string, n_jds long, first_jd_id long")
EVENT = "event_id long, ts timestamp_ntz, resume_id long, target_id string, action string, jd_id long, reason string"


def base(spark):
    rows = [(1, "target_1", 1, "A", 1, 10), (1, "target_2", 2, "B", 2, 20), (2, "target_1", 1, "B", 2, 20),
            (3, "target_1", 1, "Z", 0, None), (4, "target_1", 1, "B", 2, 20)]
    s = state.exact_state(spark.createDataFrame(rows, STATE))
    c = [(1, "target_1", 10, 1)] + [(r, t, j, j - 19) for r, t in ((1, "target_2"), (2, "target_1"), (4, "target_1")) for j in (20, 21)]
    return s, spark.createDataFrame(c, "resume_id long, target_id string, jd_id long, candidate_rank long")


def events(spark, *rows):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t0 + timedelta(minutes=m), *rest) for i, (m, *rest) in enumerate(rows)], EVENT)


def review(spark, s, c, decisions):
    judged = state.judged_decisions(s, c, decisions)
    winners = state.winning_decisions(judged)
    gone = {(r.resume_id, r.target_id, r.jd_id) for r in state.rejected_candidates(c, winners).collect()}
    after = {(r.resume_id, r.target_id): r for r in state.apply_decisions(s, winners).collect()}
    rejects = {r.event_id: r.reason_code for r in state.decision_rejects(judged, winners).collect()}
    return after, rejects, gone


def test_review_events(spark):
    s, c = base(spark)
    after, rejects, pairs = review(spark, s, c, events(
        spark,
        (5, 1, "target_2", "confirm", 21, None), (4, 1, "target_2", "confirm", 99, None), (6, 1, "target_2", "reject", None, "late"),
        (1, 2, " target_1 ", "reject", None, "  not \n"), (2, 2, "target_1", "confirm", 20, None),
        (1, 1, "target_1", "confirm", 10, None), (1, 9, "target_1", "confirm", 10, None), (1, 1, " ", "confirm", 10, None),
        (1, 3, "target_1", "reject", None, None), (1, 4, "target_1", "hold", 20, None),
    ))
    done = after[1, "target_2"]
    assert (done.status, done.selected_jd_id, done.resolution_method, done.requires_confirmation) == ("resolved", 21, "human_confirmed", False)
    gone = after[2, "target_1"]
    assert (gone.status, gone.selected_jd_id, gone.n_candidates, gone.rejection_reason) == ("needs_manual_resolution", None, 0, "not")
    assert gone.rejected_count == 2 and pairs == {(2, "target_1", 20), (2, "target_1", 21)} and gone.warnings[-1] == state.ALL_REJECTED
    assert after[4, "target_1"].status == "needs_confirmation" and after[1, "target_1"].selected_jd_id == 10
    assert rejects == {1: "jd_not_a_candidate", 2: "target_not_pending", 4: "target_not_pending", 5: "target_not_pending",
                       6: "unknown_target", 7: "blank_target_id", 8: "target_not_pending", 9: "unknown_action"}


def test_rollup_and_scope(spark):
    s, c = base(spark)
    rolled = {r.resume_id: r.overall_status for r in state.match_rollup(s).collect()}
    assert rolled == {1: "partially_ready", 2: "needs_confirmation", 3: "blocked", 4: "needs_confirmation"}
    bound = state.target_bindings(s).collect()
    assert [(b.resume_id, b.selected_jd_id, b.analysis_scope, b.human_confirmed) for b in bound] == [(1, 10, "partial", False)]
    assert state.check_match_state(s, c).count() == 0


def test_semantic_outcome_touches_open_targets_only(spark):
    s, _ = base(spark)
    decided = spark.createDataFrame([(3, "target_1", 2, ["w1"], ["w2", "w1"], None)],
                                    "resume_id long, target_id string, reranked_count long, build_warnings array<string>, decision_warnings array<string>, error string")
    got = {(r.resume_id, r.target_id): r for r in state.with_semantic(s, decided).collect()}
    row = got[3, "target_1"]
    assert (row.status, row.source, row.requires_confirmation, row.n_candidates) == ("needs_confirmation", "semantic", True, 2)
    assert row.warnings == [state.SEMANTIC_REVIEW, "w1", "w2"] and got[2, "target_1"].source == "exact"
    failed = decided.withColumn("error", F.lit("TimeoutError"))
    row = {(r.resume_id, r.target_id): r for r in state.with_semantic(s, failed).collect()}[3, "target_1"]
    assert row.status == "no_candidate" and row.warnings == [state.SEMANTIC_FAILED + "TimeoutError"]


def plain_fold(log, max_retries):
    """Job state machine in plain Python: (status, attempts, ignored rows)."""
    for n, (ok, retryable) in enumerate(log, 1):
        if ok:
            return "succeeded", n, len(log) - n
        if not retryable or n > max_retries:
            return "failed", n, len(log) - n
    return "retry_pending", len(log), 0


@pytest.mark.parametrize("max_retries", [0, 2, 3])
def test_fold_equals_state_machine(spark, max_retries):
    from datetime import datetime, timedelta

    rng, rows, expected = random.Random(max_retries), [], {}
    for job in range(40):
        log = [(rng.random() < 0.25, rng.random() < 0.8) for _ in range(rng.randint(1, 7))]
        expected[job] = plain_fold(log, max_retries)
        rows += [(job, 1, 100 * job + i, datetime(2024, 1, 1) + timedelta(seconds=i // 2), ok, again) for i, (ok, again) in enumerate(log)]
    cfg = RetryConfig(max_retries=max_retries)
    attempts = spark.createDataFrame(rows, "resume_id long, jd_id long, event_id long, ts timestamp_ntz, succeeded boolean, retryable boolean").repartition(5)
    folded = runs.attempt_fold(attempts, cfg)
    late = {r.resume_id: r["count"] for r in runs.check_attempts(attempts, folded).groupBy("resume_id").count().collect()}
    got = {r.resume_id: (r.status, r.attempts, late.get(r.resume_id, 0)) for r in folded.collect()}
    assert got == expected


def test_stored_job_states(spark):
    e = lambda n, again=True: (n, again)
    rows = [
        (1, "succeeded", True, 1, [e(1)]), (2, "succeeded", False, 0, []), (3, "pending", False, 0, [e(1)]), (4, "failed", False, 0, []),
        (5, "failed", False, 1, [e(1), e(3)]), (6, "failed", False, 1, [e(1, False), e(2)]), (7, "retry_pending", False, 0, [e(1, False)]),
        (8, "failed", False, 3, [e(1), e(2), e(3), e(4)]), (9, "retry_pending", False, 2, [e(1), e(2), e(3)]),
        (10, "failed", False, 0, [e(1)]), (11, "failed", False, 2, [e(1), e(2), e(3)]), (12, "pending", False, 0, []),
    ]
    df = spark.createDataFrame([(1, *r) for r in rows], "resume_id long, jd_id long, status string, has_report boolean, retry_count int, errors array<struct<attempt_number:int,retryable:boolean>>")
    got = {r.jd_id: r.rule for r in runs.check_job_states(df).collect()}
    assert got == {2: "report_iff_succeeded", 3: "pending_with_history", 4: "error_count", 5: "attempt_numbers", 6: "run_after_final_error",
                   7: "retry_of_final_error", 8: "over_budget", 9: "budget_spent", 10: "failed_with_budget"}
