"""From retrieved chunks to ranked JD candidates per target.

All groupings share the hash partitioning on the target, so one exchange serves the whole file, and none is needed for
hits that ``nearest_chunks`` has dealt by target. A target holds at most (its queries x top_k) rows. Hits that come as one list per query
stay lists until a target's candidates are ranked (``recall_lists``), and only those that can be kept become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from talentweave.config import TARGET_KEYS, TITLE, RecallConfig
from talentweave.functions import text as X
from talentweave.functions.rows import explode_rows
from talentweave.operators.recall_lists import list_candidates, list_foremost

# Scores are compared after rounding to this many digits: the order in which a cluster adds
# numbers must not decide a rank.
RANK_DIGITS = 12


def _by_value(column: Column, table: dict) -> Column:
    """Small fixed lookup as a literal map; unknown keys give NULL."""
    pairs = [F.lit(v) for item in table.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), column)


def with_effective_weights(queries: DataFrame, cfg: RecallConfig = RecallConfig()) -> DataFrame:
    """Type budget over the active query kinds, and each query's share of the budget of its kind."""
    per_target = Window.partitionBy(*TARGET_KEYS)
    per_type = Window.partitionBy(*TARGET_KEYS, "query_type")
    base = _by_value(F.col("query_type"), cfg.type_weights)
    active = F.aggregate(
        "_kinds", F.lit(0.0), lambda acc, kind: acc + _by_value(kind, cfg.type_weights)
    )
    return (
        queries.withColumn("_kinds", F.array_sort(F.collect_set("query_type").over(per_target)))
        .withColumn("_raw_sum", F.sum("weight").over(per_type))
        .withColumn("n_queries_of_type", F.count("*").over(per_type))
        .withColumn("n_queries", F.count("*").over(per_target))
        .withColumn("active_types", F.size("_kinds"))
        .withColumn("normalized_type_weight", base / active)
        .withColumn("penalty", _by_value(F.col("active_types"), cfg.active_penalties))
        .withColumn("effective_type_weight", F.col("normalized_type_weight") * F.col("penalty"))
        .withColumn(
            "effective_weight", F.col("effective_type_weight") * F.try_divide(F.col("weight"), F.col("_raw_sum"))
        )
        .drop("_kinds", "_raw_sum")
    )


def type_weight_plan(weighted: DataFrame) -> DataFrame:
    """One row per (target, active query kind)."""
    return weighted.groupBy(*TARGET_KEYS, "query_type").agg(
        F.first("n_queries_of_type").alias("n_queries_of_type"),
        F.first("active_types").alias("active_types"),
        F.first("penalty").alias("penalty"),
        F.first("normalized_type_weight").alias("normalized_type_weight"),
        F.first("effective_type_weight").alias("effective_type_weight"),
    )


def usable_hits(hits: DataFrame, cfg: RecallConfig = RecallConfig()) -> DataFrame:
    if cfg.minimum_similarity is None:
        return hits
    if "hits" in hits.columns:
        return hits.withColumn("hits", F.filter("hits", lambda h: (F.lit(1.0) - h["distance"]) >= cfg.minimum_similarity))
    return hits.where(F.col("similarity") >= cfg.minimum_similarity)


def best_chunk_per_query(hits: DataFrame, cfg: RecallConfig = RecallConfig()) -> DataFrame:
    """Best chunk of each (target, query, JD). Chunk rank follows similarity, so the lowest rank wins.

    Hits in lists stay lists of all that are usable: the best of each JD is taken from them where all lists of a target are judged
    (``recall_candidates``), by ``recall_lists.best_of``.
    """
    if "hits" in hits.columns:
        return usable_hits(hits, cfg)
    return usable_hits(hits, cfg).groupBy(*TARGET_KEYS, "query_id", "jd_id").agg(
        F.min("chunk_rank").alias("chunk_rank"),
        F.min_by("chunk_id", "chunk_rank").alias("chunk_id"),
        F.min_by("similarity", "chunk_rank").alias("similarity"),
        F.count("*").alias("chunk_hits"),
    )


def query_evidence(best: DataFrame, weighted: DataFrame) -> DataFrame:
    """What each best chunk adds. Facts come to a target as one row, so hits that are dealt by target stay where they are,
    and are not sorted. A list of hits meets the facts of its query as a list."""
    names = ["query_type", "query_order", "penalty", "n_queries", "effective_weight"]
    facts = weighted.groupBy(*TARGET_KEYS).agg(F.collect_list(F.struct("query_id", *names)).alias("_facts"))
    own = F.filter("_facts", lambda f: f["query_id"] == F.col("query_id"))
    rows = best.join(facts.hint("shuffle_hash"), TARGET_KEYS).withColumn("_own", own).drop("_facts")
    evidence = explode_rows(rows, best.columns, "_own", "f").select(
        *TARGET_KEYS, "query_id", *[c for c in best.columns if c not in (*TARGET_KEYS, "query_id")], *[F.col(f"f.{n}").alias(n) for n in names])
    if "hits" in best.columns:
        return evidence
    return evidence.withColumn("weighted_similarity", F.col("similarity") * F.col("effective_weight"))


def _first_seen(evidence: DataFrame) -> tuple[list[Column], Column]:
    """Aggregates that find the least (query_order, chunk_rank), and the pair made of them.

    Pairs of whole numbers are packed into one: a struct would make Spark sort all evidence to aggregate it.
    """
    kinds = dict(evidence.dtypes)
    if kinds["query_order"] != "int" or kinds["chunk_rank"] != "int":
        return [F.min(F.struct("query_order", "chunk_rank")).alias("_seen")], F.col("_seen")
    # The order is the upper half and the rank the lower; NULL comes first, as in a struct.
    half, least = F.lit(1 << 32), F.lit(-(1 << 31))
    rank = F.coalesce(F.col("chunk_rank").cast("long"), least) - least
    known = F.col("query_order").isNotNull()
    both = F.when(known, F.col("query_order").cast("long") * half + rank)
    order = F.when(F.col("_lone").isNull(), F.shiftright("_both", 32).cast("int"))
    low = F.coalesce("_lone", F.col("_both") - F.shiftright("_both", 32) * half) + least
    pair = F.struct(order.alias("query_order"), F.nullif(low, least).cast("int").alias("chunk_rank"))
    return [F.min(both).alias("_both"), F.min(F.when(~known, rank)).alias("_lone")], pair


def recall_candidates(evidence: DataFrame, cfg: RecallConfig = RecallConfig()) -> DataFrame:
    """Scores of every (target, JD). Evidence in lists gives one row per target, with its candidates as ``candidates``."""
    if "hits" in evidence.columns:
        facts = F.struct("query_order", "penalty", "n_queries", "effective_weight", (F.col("query_type") == TITLE).alias("is_title"), "hits")
        lists = evidence.groupBy(*TARGET_KEYS).agg(F.collect_list(facts).alias("_evidence"))
        return lists.select(*TARGET_KEYS, list_candidates(cfg.best_weight)("_evidence").alias("candidates"))
    seen, first_seen = _first_seen(evidence)
    scored = evidence.groupBy(*TARGET_KEYS, "jd_id").agg(
        F.max(F.when(F.col("query_type") == TITLE, F.col("similarity"))).alias("title_query_similarity"),
        F.max("similarity").alias("best_similarity"),
        F.sum("weighted_similarity").alias("evidence_score"),
        F.sum("effective_weight").alias("_matched"),
        F.first("penalty").alias("_penalty"),
        F.first("n_queries").alias("total_query_count"),
        F.count("*").alias("matched_query_count"),
        F.sum("chunk_hits").alias("chunk_hit_count"),
        *seen,
    )
    aggregate = F.col("best_similarity") * cfg.best_weight + F.col("evidence_score") * (1.0 - cfg.best_weight)
    return (
        _covered(scored.withColumn("first_seen", first_seen)).withColumn("aggregate_score", aggregate).drop("_seen", "_both", "_lone")
    )


def _covered(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("weighted_query_coverage", X.clamp01(F.col("_matched") / F.col("_penalty"))).drop("_matched", "_penalty")


def type_breakdown(candidates: DataFrame, evidence: DataFrame, plan: DataFrame) -> DataFrame:
    """Contribution of every active query kind to every candidate, also where nothing matched."""
    matched = evidence.groupBy(*TARGET_KEYS, "jd_id", "query_type").agg(
        F.count("*").alias("matched_query_count"),
        F.sum("effective_weight").alias("_matched"),
        F.max("similarity").alias("best_similarity"),
        F.sum("weighted_similarity").alias("weighted_contribution"),
    )
    wanted = candidates.select(*TARGET_KEYS, "jd_id").join(plan, TARGET_KEYS)
    return (
        wanted.join(matched, [*TARGET_KEYS, "jd_id", "query_type"], "left")
        .withColumn("matched_query_count", F.coalesce("matched_query_count", F.lit(0)))
        .withColumn("weighted_contribution", F.coalesce("weighted_contribution", F.lit(0.0)))
        .withColumn("query_coverage", X.clamp01(F.coalesce("_matched", F.lit(0.0)) / F.col("effective_type_weight")))
        .drop("_matched")
    )


def check_contribution_sum(candidates: DataFrame, breakdown: DataFrame) -> DataFrame:
    """Candidates with the sum of their contributions and whether it equals the evidence score."""
    sums = breakdown.groupBy(*TARGET_KEYS, "jd_id").agg(F.sum("weighted_contribution").alias("contribution_sum"))
    a, b = F.col("evidence_score"), F.col("contribution_sum")
    tolerance = F.greatest(F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-12))
    return candidates.join(sums, [*TARGET_KEYS, "jd_id"]).withColumn("consistent", F.abs(a - b) <= tolerance)


def ranked_candidates(candidates: DataFrame, top_n: int) -> DataFrame:
    """The ``top_n`` best candidates of each target; of candidates in lists only those that can be among them become rows."""
    if "aggregate_score" not in candidates.columns:
        near = candidates.select(*TARGET_KEYS, list_foremost(top_n)("candidates").alias("_near"))
        candidates = _covered(explode_rows(near, TARGET_KEYS, "_near", "c").select(*TARGET_KEYS, "c.*"))

    def high(name: str) -> Column:
        return F.desc_nulls_last(F.round(F.col(name), RANK_DIGITS))

    order = Window.partitionBy(*TARGET_KEYS).orderBy(
        high("aggregate_score"), high("title_query_similarity"), high("weighted_query_coverage"),
        high("best_similarity"), "first_seen", "jd_id",
    )
    return candidates.withColumn("recall_rank", F.row_number().over(order)).where(F.col("recall_rank") <= top_n)


def visible_evidence(evidence: DataFrame, cfg: RecallConfig = RecallConfig()) -> DataFrame:
    order = Window.partitionBy(*TARGET_KEYS, "jd_id").orderBy(
        F.round("weighted_similarity", RANK_DIGITS).desc(), F.round("similarity", RANK_DIGITS).desc(),
        "query_order", "query_id",
    )
    ranked = evidence.withColumn("evidence_rank", F.row_number().over(order))
    return ranked if cfg.evidence_limit is None else ranked.where(F.col("evidence_rank") <= cfg.evidence_limit)


def recall_summary(weighted: DataFrame, hits: DataFrame, candidates: DataFrame, cfg: RecallConfig) -> DataFrame:
    """Counts per target: queries, retrieved and usable chunks, candidates before and after the cut."""
    ok = F.lit(True) if cfg.minimum_similarity is None else F.col("similarity") >= cfg.minimum_similarity
    queries = weighted.groupBy(*TARGET_KEYS).agg(F.count("*").alias("total_query_count"))
    found = hits.groupBy(*TARGET_KEYS).agg(
        F.count("*").alias("total_retrieved"), F.count_if(ok).alias("total_usable")
    )
    kept = candidates.groupBy(*TARGET_KEYS).agg(F.count("*").alias("candidates_before_limit"))
    zero = F.lit(0).cast("long")
    return (
        queries.join(found, TARGET_KEYS, "left").join(kept, TARGET_KEYS, "left")
        .select(
            *TARGET_KEYS, "total_query_count",
            *[F.coalesce(c, zero).alias(c) for c in ("total_retrieved", "total_usable", "candidates_before_limit")],
        )
        .withColumn("returned", F.least("candidates_before_limit", F.lit(cfg.top_n).cast("long")))
    )


def check_query_units(units: DataFrame) -> DataFrame:
    """Targets whose query units break a retrieval rule, with the first rule broken."""
    facts = units.groupBy(*TARGET_KEYS).agg(
        F.count("*").alias("n_units"),
        F.count_distinct(X.strip(F.col("query_id"))).alias("n_ids"),
        F.count_distinct(X.strip(F.col("requested_job_title"))).alias("n_titles"),
        F.bool_or(X.is_blank(F.col("requested_job_title"))).alias("blank_title"),
        F.bool_or(X.is_blank(F.col("query_id"))).alias("blank_id"),
        F.bool_or(X.is_blank(F.col("text"))).alias("blank_text"),
    )
    reason = (
        F.when(X.is_blank(F.col("target_id")), "blank_target_id")
        .when(F.col("blank_title") | (F.col("n_titles") != 1), "title_not_unique")
        .when(F.col("blank_id"), "blank_query_id")
        .when(F.col("n_ids") != F.col("n_units"), "duplicate_query_id")
        .when(F.col("blank_text"), "blank_text")
    )
    return facts.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*TARGET_KEYS, "n_units", "reason")


def unit_problems(cfg: RecallConfig = RecallConfig()) -> dict[str, Column]:
    """Conditions under which one embedded query unit can't be used, by reason: what can be seen in its own row."""
    return {
        "blank_target_id": X.is_blank(F.col("target_id")),
        "title_not_unique": X.is_blank(F.col("requested_job_title")),
        "blank_query_id": X.is_blank(F.col("query_id")),
        "blank_text": X.is_blank(F.col("text")),
        "unknown_query_type": ~F.col("query_type").isin(*cfg.type_weights),
        "bad_weight": ~(X.is_finite(F.col("weight")) & (F.col("weight") > 0)),
    }


def observed_units(units: DataFrame, cfg: RecallConfig = RecallConfig()) -> tuple[DataFrame, Observation]:
    """``units`` that count themselves while they are used: all of them (``rows``) and those with a problem, by reason."""
    seen = Observation()
    counts = [F.count_if(F.coalesce(wrong, F.lit(True))).alias(reason) for reason, wrong in unit_problems(cfg).items()]
    return units.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen


def check_recall_input(queries: DataFrame, hits: DataFrame, cfg: RecallConfig = RecallConfig()) -> DataFrame:
    """One row per target with the first aggregation rule it breaks, ``reason`` NULL when it is sound."""
    known = F.col("query_type").isin(*cfg.type_weights)
    q = queries.groupBy(*TARGET_KEYS).agg(
        F.count("*").alias("n_queries"),
        F.count_distinct("query_id").alias("n_ids"),
        F.count_if(X.is_blank(F.col("query_id"))).alias("n_blank_ids"),
        F.count_if(F.col("query_type") == TITLE).alias("n_title_queries"),
        F.count_if(~known).alias("n_unknown_types"),
        F.count_if(~(X.is_finite(F.col("weight")) & (F.col("weight") > 0))).alias("n_bad_weights"),
        F.count_distinct("query_type").alias("n_active"),
    )
    h = hits.groupBy(*TARGET_KEYS).agg(F.count_if(~X.is_finite(F.col("similarity"))).alias("n_bad_similarities"))
    reason = (
        F.when((F.col("n_blank_ids") > 0) | (F.col("n_ids") != F.col("n_queries")), "query_id_not_unique")
        .when(F.col("n_unknown_types") > 0, "unknown_query_type")
        .when(F.col("n_bad_weights") > 0, "bad_weight")
        .when(F.col("n_bad_similarities") > 0, "similarity_not_finite")
        .when(F.col("n_title_queries") != 1, "title_query_count")
        .when(~F.col("n_active").isin(*cfg.active_penalties), "no_penalty_for_active_count")
    )
    return q.join(h, TARGET_KEYS, "left").select(*TARGET_KEYS, "n_queries", "n_title_queries", reason.alias("reason"))
