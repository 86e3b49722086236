"""Pair scoring of the recalled JDs and the decision per target.

Passages are chosen per JD and query kind before any pair is made, so a (query, JD) pair of a target
meets at most ``max_passages`` passages. Scores travel without their texts after scoring.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave.config import SECTION_PRIORITY, TARGET_KEYS, TITLE, RerankConfig
from talentweave.functions import text as X
from talentweave.functions.rows import explode_rows
from talentweave.functions.scorers import SCORE_ERROR, JaccardScorer
from talentweave.operators.passages import selected_passages
from talentweave.operators.recall import RANK_DIGITS, _by_value
from talentweave.plans.storage import materialize

# Decision warnings.
NO_RECALL = "粗召回阶段没有产生候选JD"
NO_DOCUMENT = "所有粗召回候选均缺少可用的完整JD"
SOME_MISSING = "部分粗召回候选缺少完整JD: "
NONE_ELIGIBLE = "没有候选JD通过最低岗位标题相关分阈值"
MANUAL_NEEDED = "语义兜底岗位默认需要人工确认"
SCORE_LOW = "第一候选未达到自动确认分数阈值"
MARGIN_LOW = "前两名岗位解析分差不足，需要人工确认"

CANDIDATE_KEYS = [*TARGET_KEYS, "jd_id"]


def recalled_jds(jd: DataFrame, recalled: DataFrame) -> DataFrame:
    """JDs that were recalled for any target. No other needs a document, and JDs may be many times as many."""
    ids = materialize(recalled.select(F.col("jd_id").alias("id")).distinct(), "recalled-jds")
    return jd.join(ids, "id", "left_semi")


def missing_documents(recalled: DataFrame, documents: DataFrame) -> DataFrame:
    return recalled.join(documents.select("jd_id"), "jd_id", "left_anti")


def title_pairs(recalled: DataFrame, documents: DataFrame, prepare=None) -> DataFrame:
    """Recalled JDs that have a document, with the requested title and the JD header to compare."""
    heads = documents.select("jd_id", "job_title", "department", F.col("title_passage").alias("right_text"))
    if prepare is not None:
        heads = heads.withColumn("right_ready", prepare(F.col("right_text")))
    return recalled.join(heads, "jd_id").withColumn(
        "left_text", F.concat(F.lit("申请岗位："), F.col("requested_job_title"))
    )


def document_passages(documents: DataFrame, cfg: RerankConfig = RerankConfig(), prepare=None) -> DataFrame:
    """``(jd_id, query_type, chosen)``: the passages each query kind is scored against.

    With ``prepare`` each passage also gets ``right_ready``, the form its scorer works on.
    """
    passages = F.col("passages")
    if prepare is not None:
        passages = F.transform(passages, lambda p: p.withField("right_ready", prepare(p["text"])))
    choices = F.array(*[
        F.struct(F.lit(kind).alias("query_type"),
                 selected_passages(F.col("_passages"), kind, cfg.max_passages).alias("chosen"))
        for kind in SECTION_PRIORITY
    ])
    return explode_rows(documents.withColumn("_passages", passages), ["jd_id"], choices, "c").select("jd_id", "c.*")


def support_pairs(
    recalled: DataFrame, queries: DataFrame, documents: DataFrame, cfg: RerankConfig = RerankConfig(), prepare=None, scorer=None
) -> DataFrame:
    """Résumé evidence against chosen JD passages, at most ``max_passages`` per (query, JD).

    With ``prepare`` both sides carry the form their scorer works on (``left_ready``, ``right_ready``), made once per passage
    and once per (query, JD): evidence moves to the JDs as text, which is a fraction of its prepared form. A ``scorer`` that has ``shorten``
    and ``expand`` beside ``prepare`` does all but the last step once per query, before evidence meets the recalled JDs.
    """
    if scorer is not None:
        prepare = scorer.prepare
    split = hasattr(scorer, "shorten") and hasattr(scorer, "expand")
    asked = queries.where((F.col("query_type") != TITLE) & ~X.is_blank(F.col("resume_evidence_text"))).select(
        *TARGET_KEYS, "query_id", "query_type", "query_order", F.col("resume_evidence_text").alias("left_text"),
        *([scorer.shorten(F.col("resume_evidence_text")).alias("_short")] if split else []),
    )
    pairs = recalled.select(*CANDIDATE_KEYS).join(asked, TARGET_KEYS).join(
        document_passages(documents, cfg, prepare), ["jd_id", "query_type"]
    )
    keep = [*CANDIDATE_KEYS, "query_id", "query_type", "query_order", "left_text"]
    ready_left, ready_right = [], []
    if prepare is not None:
        ready = scorer.expand(F.col("_short")) if split else prepare(F.col("left_text"))
        ready_left, ready_right = [ready.alias("left_ready")], [F.col("p.right_ready").alias("right_ready")]
    exploded = explode_rows(pairs, [*keep, *ready_left], "chosen", "p", "passage_pos")
    return exploded.select(
        *keep, *(["left_ready"] if ready_left else []), "passage_pos", F.col("p.section").alias("section"), F.col("p.text").alias("right_text"), *ready_right
    )


def score_pairs_input(titles: DataFrame, support: DataFrame) -> DataFrame:
    """Both kinds of pairs in one table, tagged by ``kind``."""
    keep = [*CANDIDATE_KEYS, "kind", "query_id", "section", "left_text", "right_text"]
    return titles.select(
        *CANDIDATE_KEYS, F.lit("title").alias("kind"), F.lit(None).cast("string").alias("query_id"),
        F.lit(None).cast("string").alias("section"), "left_text", "right_text",
    ).unionByName(support.withColumn("kind", F.lit("support")).select(*keep))


def score_pairs(pairs: DataFrame, scorer=None, out: str = "score") -> DataFrame:
    """Add a score in [0, 1] to every pair of non-blank texts; with a scorer that may fail also ``score_error``."""
    scorer = scorer or JaccardScorer()
    ready = pairs.where(~X.is_blank(F.col("left_text")) & ~X.is_blank(F.col("right_text")))
    for side in ("left", "right"):
        if f"{side}_ready" not in ready.columns:
            ready = ready.withColumn(f"{side}_ready", scorer.prepare(F.col(f"{side}_text")))
    return scorer.score(ready, "left_ready", "right_ready", out).drop("left_ready", "right_ready")


def title_scores(recalled: DataFrame, documents: DataFrame, scorer=None) -> DataFrame:
    """Recalled JDs that have a document, with ``title_similarity``; headers are prepared once per JD."""
    scorer = scorer or JaccardScorer()
    pairs = title_pairs(recalled, documents, scorer.prepare)
    return score_pairs(pairs, scorer, "title_similarity").drop("left_text", "right_text")


def best_scores(scored: DataFrame) -> DataFrame:
    """Best score of each (target, JD, query): all that the support score needs, by hash aggregation. An error stays beside it."""
    errors = [F.min(SCORE_ERROR).alias(SCORE_ERROR)] if SCORE_ERROR in scored.columns else []
    return scored.groupBy(*CANDIDATE_KEYS, "query_id", "query_type").agg(F.max("score").alias("score"), *errors)


def scoring_errors(*scored: DataFrame) -> DataFrame | None:
    """``resume_id, target_id, error``: targets that have a pair without a score, with the least error; None if nothing can fail."""
    failing = [s.where(F.col(SCORE_ERROR).isNotNull()).select(*TARGET_KEYS, SCORE_ERROR) for s in scored if SCORE_ERROR in s.columns]
    if not failing:
        return None
    return reduce(DataFrame.unionByName, failing).groupBy(*TARGET_KEYS).agg(F.min(SCORE_ERROR).alias("error"))


def best_passages(scored: DataFrame) -> DataFrame:
    """Best passage of each (target, JD, query), for display; of equal scores the first passage wins."""
    order = Window.partitionBy(*CANDIDATE_KEYS, "query_id").orderBy(F.col("score").desc(), "passage_pos")
    return scored.select(
        *CANDIDATE_KEYS, "query_id", "query_type", "query_order", "passage_pos", "section", "score",
        F.row_number().over(order).alias("_r"),
    ).where(F.col("_r") == 1).drop("_r")


def support_type_scores(best: DataFrame, cfg: RerankConfig = RerankConfig()) -> DataFrame:
    means = best.groupBy(*CANDIDATE_KEYS, "query_type").agg(
        F.count("*").alias("query_count"), F.avg("score").alias("mean_best_score")
    ).withColumn("_w", _by_value(F.col("query_type"), cfg.type_weights))
    total = F.sum("_w").over(Window.partitionBy(*CANDIDATE_KEYS))
    return (
        means.withColumn("normalized_weight", F.col("_w") / total)
        .withColumn("weighted_contribution", F.col("mean_best_score") * F.col("normalized_weight")).drop("_w")
    )


def support_scores(candidates: DataFrame, type_scores: DataFrame) -> DataFrame:
    """Support score of every candidate, 0 where nothing could be compared."""
    sums = type_scores.groupBy(*CANDIDATE_KEYS).agg(F.sum("weighted_contribution").alias("_s"))
    return (
        candidates.join(sums, CANDIDATE_KEYS, "left")
        .withColumn("resume_support_score", X.clamp01(F.coalesce("_s", F.lit(0.0)))).drop("_s")
    )


def support_evidence(best: DataFrame, cfg: RerankConfig = RerankConfig()) -> DataFrame:
    order = Window.partitionBy(*CANDIDATE_KEYS).orderBy(
        F.round("score", RANK_DIGITS).desc(), "query_order", "query_id"
    )
    return best.withColumn("evidence_rank", F.row_number().over(order)).where(F.col("evidence_rank") <= cfg.max_evidence)


def rerank_candidates(
    title_scored: DataFrame, type_scores: DataFrame, cfg: RerankConfig = RerankConfig()
) -> DataFrame:
    """The three scores, their weighted sum and the threshold flag of every candidate with a document."""
    floor = cfg.minimum_title_similarity
    passes = F.lit(True) if floor is None else F.col("title_similarity") >= floor
    return (
        support_scores(title_scored, type_scores)
        .withColumn("recall_score", X.clamp01(F.col("aggregate_score")))
        .withColumn("resolution_score", X.clamp01(
            F.col("title_similarity") * cfg.title_weight
            + F.col("resume_support_score") * cfg.support_weight
            + F.col("recall_score") * cfg.recall_weight
        ))
        .withColumn("passes_title_threshold", passes)
    )


def ranked_rerank(candidates: DataFrame, cfg: RerankConfig = RerankConfig()) -> DataFrame:
    def high(name: str) -> Column:
        return F.round(F.col(name), RANK_DIGITS).desc()

    order = Window.partitionBy(*TARGET_KEYS).orderBy(
        F.col("passes_title_threshold").desc(), high("resolution_score"), high("title_similarity"),
        high("resume_support_score"), high("recall_score"), "recall_rank",
    )
    return candidates.withColumn("rerank_rank", F.row_number().over(order)).where(F.col("rerank_rank") <= cfg.top_n)


def rerank_decision(
    targets: DataFrame, recalled: DataFrame, missing: DataFrame, ranked: DataFrame, cfg: RerankConfig = RerankConfig()
) -> DataFrame:
    """One row per target: status, recommendation, margin, warnings and the kept candidates."""
    eligible = F.col("passes_title_threshold")
    kept = ranked.groupBy(*TARGET_KEYS).agg(
        F.count("*").alias("reranked_count"),
        F.count_if(eligible).alias("eligible_count"),
        F.max(F.when(eligible & (F.col("rerank_rank") == 1), F.col("jd_id"))).alias("_first"),
        F.max(F.when(eligible & (F.col("rerank_rank") == 1), F.col("resolution_score"))).alias("_score1"),
        F.max(F.when(eligible & (F.col("rerank_rank") == 2), F.col("resolution_score"))).alias("_score2"),
        F.array_sort(F.collect_list(F.struct(
            F.col("rerank_rank").cast("long").alias("candidate_rank"), "jd_id", "job_title", "department",
            F.col("resolution_score").alias("score"),
        ))).alias("candidates"),
    )
    recall = recalled.groupBy(*TARGET_KEYS).agg(F.count("*").alias("recall_count"))
    lost = missing.groupBy(*TARGET_KEYS).agg(
        F.array_sort(F.collect_list(F.struct("recall_rank", "jd_id")))["jd_id"].alias("missing_jd_ids")
    )
    rows = (
        targets.join(recall, TARGET_KEYS, "left").join(lost, TARGET_KEYS, "left").join(kept, TARGET_KEYS, "left")
        .withColumn("recall_count", F.coalesce("recall_count", F.lit(0).cast("long")))
        .withColumn("reranked_count", F.coalesce("reranked_count", F.lit(0).cast("long")))
        .withColumn("eligible_count", F.coalesce("eligible_count", F.lit(0).cast("long")))
        .withColumn("missing_jd_ids", F.coalesce("missing_jd_ids", F.array().cast("array<bigint>")))
        .withColumn("top_margin", F.when(F.col("eligible_count") > 1, F.col("_score1") - F.col("_score2")))
    )
    score_ok = F.round("_score1", RANK_DIGITS) >= cfg.auto_confirm_threshold
    margin_ok = F.col("top_margin").isNull() | (F.round("top_margin", RANK_DIGITS) >= cfg.minimum_top_margin)
    auto = score_ok & margin_ok & F.lit(not cfg.require_manual_confirmation)
    nothing, none_fit = F.col("reranked_count") == 0, F.col("eligible_count") == 0
    status = (
        F.when(nothing, "no_candidate").when(none_fit, "no_eligible_candidate")
        .when(auto, "auto_resolved").otherwise("needs_confirmation")
    )
    has_missing = F.size("missing_jd_ids") > 0
    reason = (
        F.when(F.col("recall_count") == 0, NO_RECALL).when(nothing, NO_DOCUMENT).when(none_fit, NONE_ELIGIBLE)
        .when(auto, None).when(F.lit(cfg.require_manual_confirmation), MANUAL_NEEDED)
        .when(~score_ok, SCORE_LOW).otherwise(MARGIN_LOW)
    )
    listed = F.concat(F.lit(SOME_MISSING), F.array_join(F.col("missing_jd_ids").cast("array<string>"), "、"))
    return (
        rows.withColumn("status", status)
        .withColumn("recommended_jd_id", F.col("_first"))
        .withColumn("selected_jd_id", F.when(F.col("status") == "auto_resolved", F.col("_first")))
        .withColumn("needs_confirmation", F.col("status").isin("needs_confirmation", "no_eligible_candidate"))
        .withColumn("decision_warnings", F.array_compact(F.array(F.when(has_missing & ~nothing, listed), reason)))
        .drop("_first", "_score1", "_score2")
    )


def check_rerank_input(recalled: DataFrame, queries: DataFrame, title_scores: DataFrame) -> DataFrame:
    """One row per target with the first stage rule it breaks, ``reason`` NULL when it is sound."""
    r = recalled.groupBy(*TARGET_KEYS).agg(
        F.count("*").alias("n_candidates"), F.count_distinct("jd_id").alias("n_jds"),
        F.min("requested_job_title").alias("recall_title"), F.max("requested_job_title").alias("_other_title"),
    )
    q = queries.groupBy(*TARGET_KEYS).agg(F.min("requested_job_title").alias("query_title"))
    t = title_scores.groupBy(*TARGET_KEYS).agg(F.count_distinct("jd_id").alias("n_scored"))
    reason = (
        F.when(F.col("query_title").isNull(), "target_without_queries")
        .when(~F.col("recall_title").eqNullSafe(F.col("query_title"))
              | ~F.col("recall_title").eqNullSafe(F.col("_other_title")), "title_differs")
        .when(F.col("n_jds") != F.col("n_candidates"), "duplicate_jd")
        .when(F.coalesce("n_scored", F.lit(0)) < F.col("n_jds"), "title_score_missing")
    )
    return r.join(q, TARGET_KEYS, "left").join(t, TARGET_KEYS, "left").select(
        *TARGET_KEYS, "n_candidates", F.coalesce("n_scored", F.lit(0).cast("long")).alias("n_scored"),
        reason.alias("reason"),
    )
