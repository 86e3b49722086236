"""Match state per target, review decisions and the roll-up per résumé."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentweave.config import TARGET_KEYS
from talentweave.functions import text as X

# State warnings.
MANY_EXACT = "同名岗位匹配到多个 JD，请人工选择"
SEMANTIC_REVIEW = "语义候选必须经人工确认后才能进入 Agent"
ALL_REJECTED = "人工已拒绝当前全部候选 JD，需要重新描述目标岗位"
SEMANTIC_FAILED = "语义匹配执行失败: "

_TEXTS = "array<string>"


def exact_state(matches: DataFrame) -> DataFrame:
    """State after exact matching; ``matches`` has one row per target with ``n_jds`` and ``first_jd_id``.

    One JD resolves the target, several wait for a person, none leaves it to semantic matching
    (``no_candidate`` until then).
    """
    n = F.col("n_jds")
    return matches.select(
        *TARGET_KEYS, "target_pos", "requested_job_title",
        F.when(n == 1, "resolved").when(n > 1, "needs_confirmation").otherwise("no_candidate").alias("status"),
        F.when(n > 0, "exact").alias("source"),
        F.when(n == 1, F.col("first_jd_id")).alias("selected_jd_id"),
        F.when(n == 1, "unique_exact_match").alias("resolution_method"),
        n.cast("long").alias("n_candidates"),
        (n > 1).alias("requires_confirmation"),
        F.lit(None).cast("string").alias("rejection_reason"),
        F.lit(0).cast("long").alias("rejected_count"),
        F.when(n > 1, F.array(F.lit(MANY_EXACT))).otherwise(F.array().cast(_TEXTS)).alias("warnings"),
    )


def with_semantic(state: DataFrame, decisions: DataFrame) -> DataFrame:
    """Replace the open targets by their semantic outcome.

    ``decisions`` has one row per open target with ``reranked_count``, ``decision_warnings``,
    optionally ``build_warnings`` and ``error`` (a failed semantic step touches only its own target).
    """
    have = set(decisions.columns)
    build = F.col("build_warnings") if "build_warnings" in have else F.array().cast(_TEXTS)
    error = F.col("error") if "error" in have else F.lit(None).cast("string")
    d = decisions.select(
        *TARGET_KEYS, F.col("reranked_count").alias("_n"),
        F.concat(F.coalesce(build, F.array().cast(_TEXTS)), F.coalesce("decision_warnings", F.array().cast(_TEXTS)))
        .alias("_w"), error.alias("_error"),
    )
    joined = state.join(d, TARGET_KEYS, "left")
    open_, found = F.col("n_candidates") == 0, F.coalesce(F.col("_n"), F.lit(0)) > 0
    failed = F.col("_error").isNotNull()
    pending = open_ & found & ~failed
    warnings = (
        F.when(~open_, F.col("warnings"))
        .when(failed, F.array(F.concat(F.lit(SEMANTIC_FAILED), F.col("_error"))))
        .when(found, F.array_distinct(F.concat(F.array(F.lit(SEMANTIC_REVIEW)), F.col("_w"))))
        .otherwise(F.array_distinct(F.coalesce("_w", F.array().cast(_TEXTS))))
    )
    return joined.withColumns({
        "status": F.when(pending, "needs_confirmation").otherwise(F.col("status")),
        "source": F.when(pending, "semantic").otherwise(F.col("source")),
        "requires_confirmation": F.col("requires_confirmation") | pending,
        "warnings": warnings,
        "n_candidates": F.when(pending, F.col("_n")).otherwise(F.col("n_candidates")),
    }).drop("_n", "_w", "_error")


def judged_decisions(state: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every review event with ``reason_code``: NULL when it would be accepted on the initial state.

    ``candidates`` needs only the (resume_id, target_id, jd_id) that the events name.
    ``decisions``: event_id, ts, resume_id, target_id, action (confirm | reject), jd_id, reason.
    """
    events = decisions.withColumn("target_id", X.strip(F.col("target_id")))
    known = state.select(*TARGET_KEYS, F.col("status").alias("_status"), F.col("n_candidates").alias("_n"))
    listed = candidates.select(*TARGET_KEYS, "jd_id", F.lit(True).alias("_listed"))
    code = (
        F.when(F.coalesce(F.col("target_id"), F.lit("")) == "", "blank_target_id")
        .when(F.col("_status").isNull(), "unknown_target")
        .when(F.col("_status") != "needs_confirmation", "target_not_pending")
        .when((F.col("action") == "confirm") & F.col("_listed").isNull(), "jd_not_a_candidate")
        .when((F.col("action") == "reject") & (F.col("_n") == 0), "no_candidates_to_reject")
        .when(~F.col("action").isin("confirm", "reject"), "unknown_action")
    )
    return (
        events.join(known, TARGET_KEYS, "left").join(listed, [*TARGET_KEYS, "jd_id"], "left")
        .withColumn("reason_code", code).drop("_status", "_n", "_listed")
    )


def winning_decisions(judged: DataFrame) -> DataFrame:
    """First acceptable event per target in (ts, event_id) order, by partial aggregation."""
    return judged.where(F.col("reason_code").isNull()).groupBy(*TARGET_KEYS).agg(
        F.min(F.struct("ts", "event_id", "action", "jd_id", "reason")).alias("_w")
    ).select(
        *TARGET_KEYS, F.col("_w.event_id").alias("event_id"), F.col("_w.action").alias("action"),
        F.col("_w.jd_id").alias("chosen_jd_id"), F.col("_w.reason").alias("reason"),
    )


def decision_rejects(judged: DataFrame, winners: DataFrame) -> DataFrame:
    """Events that changed nothing, each with its reason."""
    won = winners.select(*TARGET_KEYS, F.col("event_id").alias("_winner"))
    late = F.when(F.col("reason_code").isNull() & (F.col("event_id") != F.col("_winner")), "target_not_pending")
    return (
        judged.join(won, TARGET_KEYS, "left").withColumn("reason_code", F.coalesce("reason_code", late))
        .where(F.col("reason_code").isNotNull()).drop("_winner")
    )


def rejected_candidates(candidates: DataFrame, winners: DataFrame) -> DataFrame:
    """Candidates of the targets whose candidates were rejected, one row each: what must not be recalled again."""
    gone = winners.where(F.col("action") == "reject").select(*TARGET_KEYS)
    return candidates.join(gone, TARGET_KEYS, "left_semi")


def apply_decisions(state: DataFrame, winners: DataFrame) -> DataFrame:
    """State after the winning review events; all other targets stay as they are.

    A rejection concerns all candidates of a target. The state counts them (``rejected_count``); ``rejected_candidates`` names them.
    """
    w = winners.select(*TARGET_KEYS, F.col("action").alias("_action"), "chosen_jd_id", F.col("reason").alias("_reason"))
    rows = state.join(w, TARGET_KEYS, "left")
    confirmed, rejected = F.col("_action") == "confirm", F.col("_action") == "reject"
    return rows.withColumns({
        "status": F.when(confirmed, "resolved").when(rejected, "needs_manual_resolution").otherwise(F.col("status")),
        "selected_jd_id": F.when(confirmed, F.col("chosen_jd_id")).when(~rejected | rejected.isNull(), F.col("selected_jd_id")),
        "resolution_method": F.when(confirmed, "human_confirmed").otherwise(F.col("resolution_method")),
        "requires_confirmation": F.when(confirmed | rejected, F.lit(False)).otherwise(F.col("requires_confirmation")),
        "rejection_reason": F.when(rejected, X.strip(F.col("_reason"))).otherwise(F.col("rejection_reason")),
        "rejected_count": F.col("rejected_count") + F.when(rejected, F.col("n_candidates")).otherwise(0),
        "warnings": F.when(
            rejected, F.array_distinct(F.concat("warnings", F.array(F.lit(ALL_REJECTED))))
        ).otherwise(F.col("warnings")),
        "n_candidates": F.when(rejected, F.lit(0).cast("long")).otherwise(F.col("n_candidates")),
    }).drop("_action", "chosen_jd_id", "_reason")


def match_rollup(state: DataFrame) -> DataFrame:
    """Counters and overall status per résumé."""
    def n(status: str):
        return F.count_if(F.col("status") == status)

    counts = state.groupBy("resume_id").agg(
        F.count("*").alias("target_count"),
        n("resolved").alias("resolved_count"),
        n("needs_confirmation").alias("pending_confirmation_count"),
        n("needs_manual_resolution").alias("manual_resolution_count"),
    )
    return counts.withColumn(
        "overall_status",
        F.when(F.col("resolved_count") == F.col("target_count"), "ready")
        .when(F.col("resolved_count") > 0, "partially_ready")
        .when(F.col("pending_confirmation_count") > 0, "needs_confirmation")
        .when(F.col("manual_resolution_count") > 0, "needs_manual_resolution")
        .otherwise("blocked"),
    )


def match_warnings(state: DataFrame, inherited: DataFrame | None = None) -> DataFrame:
    """Warnings per résumé: inherited ones first, then by target, each text once."""
    rows = state.select("resume_id", F.col("target_pos").alias("pos"), "warnings")
    if inherited is not None:
        rows = rows.unionByName(inherited.select("resume_id", F.lit(0).alias("pos"), "warnings"))
    texts = rows.select("resume_id", "pos", F.posexplode("warnings").alias("i", "w")).select(
        "resume_id", "pos", "i", X.strip(F.col("w")).alias("w")
    ).where(F.col("w") != "")
    once = texts.groupBy("resume_id", "w").agg(F.min(F.struct("pos", "i")).alias("at"))
    return once.groupBy("resume_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias("warnings")
    )


def check_match_state(state: DataFrame, candidates: DataFrame) -> DataFrame:
    """Targets that break a state rule, with the rule."""
    listed = candidates.select(*TARGET_KEYS, F.col("jd_id").alias("selected_jd_id"), F.lit(True).alias("_in"))
    pending = F.col("status") == "needs_confirmation"
    rule = (
        F.when(F.col("selected_jd_id").isNotNull() & F.col("_in").isNull(), "selected_not_a_candidate")
        .when((F.col("status") == "resolved") & F.col("selected_jd_id").isNull(), "resolved_without_selection")
        .when(pending & (~F.col("requires_confirmation") | F.col("selected_jd_id").isNotNull()), "pending_but_selected")
    )
    return (
        state.join(listed, [*TARGET_KEYS, "selected_jd_id"], "left").withColumn("rule", rule)
        .where(F.col("rule").isNotNull()).select(*TARGET_KEYS, "status", "selected_jd_id", "rule")
    )


def agent_payloads(state: DataFrame) -> DataFrame:
    """Per résumé: match status, scope, the resolved targets and the ids of the open ones.

    Résumés without any resolved target give no payload.
    """
    resolved = (F.col("status") == "resolved") & F.col("selected_jd_id").isNotNull()
    target = F.struct("target_pos", "target_id", "requested_job_title", "source", "resolution_method", "selected_jd_id")
    lists = state.groupBy("resume_id").agg(
        F.array_sort(F.collect_list(F.when(resolved, target))).alias("selected_targets"),
        F.array_sort(F.collect_list(F.when(F.col("status") != "resolved", F.struct("target_pos", "target_id"))))["target_id"]
        .alias("pending_target_ids"),
    ).where(F.size("selected_targets") > 0)
    partial = F.size("pending_target_ids") > 0
    return lists.select(
        "resume_id", F.when(partial, "partially_ready").otherwise("ready").alias("match_status"),
        F.when(partial, "partial").otherwise("complete").alias("analysis_scope"),
        F.transform("selected_targets", lambda t: t.dropFields("target_pos")).alias("selected_targets"), "pending_target_ids",
    )


def target_bindings(state: DataFrame) -> DataFrame:
    """Resolved targets with their JD, and the scope of the analysis of their résumé.

    A résumé names few positions, so the window over its targets stays small.
    """
    resolved = (F.col("status") == "resolved") & F.col("selected_jd_id").isNotNull()
    any_open = F.bool_or(~resolved).over(Window.partitionBy("resume_id"))
    return (
        state.withColumn("_open", any_open).where(resolved)
        .select(
            *TARGET_KEYS, "target_pos", "requested_job_title", "selected_jd_id", X.source_name(F.col("source")).alias("source"),
            F.when(F.col("_open"), "partial").otherwise("complete").alias("analysis_scope"),
            ((F.col("source") != "exact") | (F.col("n_candidates") > 1)).alias("human_confirmed"),
        )
    )
