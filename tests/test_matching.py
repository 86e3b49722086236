import random
import tracemalloc
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from talentweave.config import PROJECT, SKILLS, TITLE, WORK, RecallConfig, RerankConfig
from talentweave.operators import exact, passages, query_units, recall, rerank, similarity
from talentweave.schemas import RESPONSIBILITY, RESUME


@pytest.mark.parametrize("bits,levels", [(21, 3), (2, 6), (3, 3), (2, 2)])
def test_rank_in_hot_group_needs_no_whole_group(spark, bits, levels):
    ids = spark.range(0, 300, 3).unionByName(spark.createDataFrame([(-5,), (-1,), (2**40,), (2**62,)], "id long"))
    rows = ids.withColumn("g", F.when(F.col("id") % 5 < 4, "hot").otherwise("cold"))
    order = Window.partitionBy("g").orderBy("id")
    ranked = exact.rank_in_group(rows, "g", "id", "r", bits, levels).withColumn("w", F.row_number().over(order))
    assert ranked.count() == 104 and ranked.where("r <> w").count() == 0


def test_alias_only_counts_with_jds_and_direct_wins(spark):
    targets = spark.createDataFrame([(1, "target_1", t) for t in ("A", "aka A", "aka B", "C", " A ")],
                                    "resume_id long, target_id string, requested_job_title string")
    jd = spark.createDataFrame([(5, "A", "d"), (6, "A", None), (7, "C", None)], "id long, job_title string, department string")
    alias = spark.createDataFrame([("aka A", "A"), ("aka B", "B"), ("C", "A")], "alias_title string, standard_title string")
    got = {r.requested_job_title: (r.normalized_title, r.match_type, r.n_jds) for r in exact.exact_match(targets, jd, alias).collect()}
    assert got == {"A": ("A", "direct", 2), "aka A": ("A", "alias", 2), "aka B": (None, None, 0), "C": ("C", "direct", 1), " A ": ("A", "direct", 2)}


def vectors(spark, n_queries, n_chunks, dim=8, seed=5):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dim))
    chunk = centers[rng.integers(0, 6, n_chunks)] + 0.15 * rng.normal(size=(n_chunks, dim))
    chunk[: n_chunks // 3] = chunk[0]  # a third of all chunks are copies
    query = centers[rng.integers(0, 6, n_queries)] + 0.3 * rng.normal(size=(n_queries, dim))
    chunks = [(i, i % 17, "t", True, [float(x) for x in v]) for i, v in enumerate(chunk)]
    chunks += [(9001, 1, "t", True, None), (9002, 1, "t", True, [1.0]), (9003, 1, "t", True, [float("nan")] * dim),
               (9004, 1, "t", True, [0.0] * dim), (9005, 1, "t", False, chunks[0][4])]
    queries = [(i // 3, "target_1", f"q{i}", [float(x) for x in v]) for i, v in enumerate(query)]
    gone = {(i // 3, "target_1", i % 17) for i in range(n_queries) if i % 2} | {(0, "target_1", 999), (10**6, "target_1", 1)}
    rejected = spark.createDataFrame([*gone, *gone], "resume_id long, target_id string, jd_id long")
    c = spark.createDataFrame(chunks, "chunk_id long, jd_id long, chunk_type string, is_embedding_target boolean, embedding array<double>")
    q = spark.createDataFrame(queries, "resume_id long, target_id string, query_id string, embedding array<double>")
    unit_c = chunk / np.linalg.norm(chunk, axis=1, keepdims=True)
    expected = {}
    for (resume, target, name, v) in queries:
        u = np.array(v) / np.linalg.norm(v)
        d = np.round(1 - unit_c @ u, 12)
        order = sorted((d[i], i) for i in range(n_chunks) if (resume, target, i % 17) not in gone)
        expected[name] = [i for _, i in order[:9]]
    return q, c, expected, rejected


@pytest.mark.parametrize("block_rows", [100_000, 40, 13])
def test_similarity_forms_equal_brute_force(spark, block_rows):
    q, c, expected, rejected = vectors(spark, 60, 240)
    hits = similarity.nearest_chunks(q, c, top_k=9, dim=8, block_rows=block_rows, rejected=rejected)
    got = defaultdict(list)
    for r in hits.orderBy("query_id", "chunk_rank").collect():
        got[r.query_id].append(r.chunk_id)
        assert r.chunk_rank == len(got[r.query_id])
    assert got == expected


def test_pages_of_a_title_with_many_jds_and_many_targets(spark):
    jd = spark.range(5000).select((F.col("id") * 7).alias("id"), F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("job_title"), F.lit("d").alias("department"))
    jd = jd.unionByName(spark.createDataFrame([(90_000, None, "d")], "id long, job_title string, department string"))
    targets = spark.range(4000).select(
        F.col("id").alias("resume_id"), F.lit("target_1").alias("target_id"), F.lit(1).alias("target_pos"),
        F.when(F.col("id") == 5, "rare").when(F.col("id") == 6, "none").otherwise("hot").alias("requested_job_title"))
    matches = exact.exact_match(targets, jd, spark.createDataFrame([], "alias_title string, standard_title string"))
    ids = {t: sorted(7 * i for i in range(5000) if (i % 50 == 0) == (t == "rare")) for t in ("rare", "hot")}
    pages = exact.candidate_pages(jd, 30)
    for page in (0, 3, 163, 200):
        found = exact.candidate_page(matches, pages, page)
        rows = {r.resume_id: r for r in found.where("resume_id < 8").collect()}
        assert found.count() == 4000 and rows[6].n_jds == 0 and rows[6].candidates == []
        for i, title in ((5, "rare"), (7, "hot")):
            assert rows[i].n_jds == len(ids[title]) and [c.jd_id for c in rows[i].candidates] == ids[title][30 * page:30 * page + 30]
            assert [c.candidate_rank for c in rows[i].candidates] == list(range(30 * page + 1, min(30 * page + 30, len(ids[title])) + 1))
    own = exact.candidate_page(matches, pages, F.col("resume_id") % 2).where("resume_id IN (7, 8)").collect()
    assert {r.resume_id: r.candidates[0].candidate_rank for r in own} == {7: 31, 8: 1}
    with pytest.raises(ValueError):
        exact.candidate_pages(jd, 0)


def test_a_target_may_have_rejected_nearly_all(spark):
    rng = np.random.default_rng(8)
    chunks = spark.createDataFrame([(i, i, "t", True, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(3000, 4)))],
                                   "chunk_id long, jd_id long, chunk_type string, is_embedding_target boolean, embedding array<double>")
    q = spark.createDataFrame([(i, "target_1", "a", [1.0, 0.0, 0.0, 0.0]) for i in (1, 2)],
                              "resume_id long, target_id string, query_id string, embedding array<double>")
    rejected = spark.range(2995).select(F.lit(1).cast("long").alias("resume_id"), F.lit("target_1").alias("target_id"), F.col("id").alias("jd_id"))
    hits = similarity.nearest_chunks(q, chunks, top_k=9, dim=4, block_rows=100, rejected=rejected).collect()
    assert {r.jd_id for r in hits if r.resume_id == 1} == set(range(2995, 3000)) and sum(r.resume_id == 2 for r in hits) == 9


def test_what_moves_does_not_depend_on_the_number_of_cells(spark, monkeypatch):
    """A query goes to each slab and a chunk to each shard once, however small the blocks are."""
    q, c, expected, rejected = vectors(spark, 60, 240)
    monkeypatch.setattr(similarity, "TASK_PAIRS", 4000)
    shards, slabs = similarity.grid(60, 244, 9, 8, spark.sparkContext.defaultParallelism)
    assert 1 < shards * slabs <= 4
    hits = similarity.nearest_chunks(q, c, top_k=9, dim=8, block_rows=2, rejected=rejected)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert f"hashpartitioning(shard#" in plan and f", {shards * slabs})" in plan
    got = defaultdict(list)
    for r in hits.orderBy("query_id", "chunk_rank").collect():
        got[r.query_id].append(r.chunk_id)
    assert got == expected


def test_hits_are_dealt_once_on_their_way_to_the_ranking(spark):
    q, c, *_ = vectors(spark, 30, 60)
    kinds = F.array(F.lit(TITLE), F.lit(WORK), F.lit(SKILLS))
    weighted = recall.with_effective_weights(q.select("resume_id", "target_id", "query_id", F.lit(1.0).alias("weight"), F.lit(0).alias("query_order"), F.element_at(
        kinds, (F.expr("CAST(substring(query_id, 2) AS INT)") % 3 + 1)).alias("query_type")))
    hits = similarity.nearest_chunks(q, c, top_k=9, dim=8)
    ranked = recall.ranked_candidates(recall.recall_candidates(recall.query_evidence(recall.best_chunk_per_query(hits), weighted)), 10)
    exchanges = [p._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") for p in (hits, ranked)]
    assert exchanges[1] == exchanges[0] + 1  # that of the weights


def test_evidence_keeps_queries_that_repeat(spark):
    best = spark.createDataFrame([(1, "t", "a", 7, 1, 3, 0.5, 2), (1, "t", "b", 7, 1, 3, 0.5, 2), (2, "t", "a", 7, 1, 3, 0.5, 2)],
                                 "resume_id long, target_id string, query_id string, jd_id long, chunk_rank int, chunk_id long, similarity double, chunk_hits long")
    facts = spark.createDataFrame([(1, "t", "a", TITLE, 0, 0.7, 3, w) for w in (0.2, 0.4)] + [(1, "t", "c", TITLE, 1, 0.7, 3, 0.1)],
                                  "resume_id long, target_id string, query_id string, query_type string, query_order int, penalty double, n_queries long, effective_weight double")
    got = recall.query_evidence(best, facts).collect()
    assert sorted((r.resume_id, r.query_id, r.weighted_similarity, r.n_queries) for r in got) == [(1, "a", 0.1, 3), (1, "a", 0.2, 3)]


def test_a_rejected_jd_stays_away_where_its_chunks_repeat(spark):
    chunks = spark.createDataFrame([(i, i, "t", True, [1.0, float(i)]) for i in (1, 2, 2, 3)],
                                   "chunk_id long, jd_id long, chunk_type string, is_embedding_target boolean, embedding array<double>")
    q = spark.createDataFrame([(r, "target_1", "a", [1.0, 0.0]) for r in (1, 2)], "resume_id long, target_id string, query_id string, embedding array<double>")
    rejected = spark.createDataFrame([(1, "target_1", 2), (1, None, 3), (None, "target_1", 3), (1, "target_1", None)], "resume_id long, target_id string, jd_id long")
    hits = similarity.nearest_chunks(q, chunks, top_k=5, dim=2, rejected=rejected).orderBy("resume_id", "chunk_rank").collect()
    assert [(r.resume_id, r.jd_id) for r in hits] == [(1, 1), (1, 3), (2, 1), (2, 2), (2, 2), (2, 3)]


def test_slabs_and_shards_are_bounded():
    for queries, chunks, dim in ((10**7, 10**5, 64), (10**5, 10**7, 64), (6 * 10**5, 6 * 10**5, 1024)):
        shards, slabs = similarity.grid(queries, chunks, 30, dim, 12)
        assert queries * (4 * dim + 720) <= shards * similarity.SHARD_BYTES and chunks * 4 * dim <= slabs * similarity.SLAB_BYTES


def test_a_pivot_without_a_usable_vector_loses_no_chunk(spark):
    chunks = spark.createDataFrame(
        [(i, i, "t", True, [1.0, float(i)] if i % 20 == 7 else [float("nan"), 1.0]) for i in range(40)],
        "chunk_id long, jd_id long, chunk_type string, is_embedding_target boolean, embedding array<double>")
    q = spark.createDataFrame([(1, "target_1", "a", [1.0, 0.0])], "resume_id long, target_id string, query_id string, embedding array<double>")
    assert [r.chunk_id for r in similarity.nearest_chunks(q, chunks, top_k=3, dim=2).orderBy("chunk_rank").collect()] == [7, 27]


def test_fewer_chunks_than_k(spark):
    q, c, *_ = vectors(spark, 3, 5)
    hits = similarity.nearest_chunks(q, c, top_k=9, dim=8)
    assert hits.groupBy("query_id").count().where("count = 5").count() == 3
    with pytest.raises(ValueError):
        similarity.nearest_chunks(q, c, top_k=0, dim=8)


def model_recall(queries, hits):
    """The recall rules for one target in plain Python, written from the description of the scores."""
    base = {TITLE: 0.40, WORK: 0.30, PROJECT: 0.18, SKILLS: 0.12}
    active = sorted({t for _, t, _ in queries})
    penalty = {1: 0.3, 2: 0.7, 3: 0.9, 4: 1.0}[len(active)]
    budget = {t: base[t] / sum(base[a] for a in active) * penalty for t in active}
    raw = {t: sum(w for _, k, w in queries if k == t) for t in active}
    weight = {q: budget[t] * w / raw[t] for q, t, w in queries}
    kind = {q: t for q, t, _ in queries}
    best = {}
    for q, jd, sim, _rank in sorted(hits, key=lambda h: h[3]):
        if (q, jd) not in best or sim > best[q, jd]:
            best[q, jd] = sim
    out = {}
    for jd in {j for _, j in best}:
        mine = {q: s for (q, j), s in best.items() if j == jd}
        evidence = sum(s * weight[q] for q, s in mine.items())
        title = [s for q, s in mine.items() if kind[q] == TITLE]
        out[jd] = (0.75 * max(mine.values()) + 0.25 * evidence, max(title) if title else None,
                   min(1.0, sum(weight[q] for q in mine) / penalty))
    return out


def test_recall_equals_plain_model(spark):
    rng = random.Random(3)
    queries, hits, expected = [], [], {}
    for target in range(12):
        kinds = [TITLE] + [rng.choice([WORK, PROJECT, SKILLS][: 1 + target % 3]) for _ in range(target % 5)]
        mine = [(f"q{i}", k, round(rng.uniform(0.5, 2), 2)) for i, k in enumerate(kinds)]
        found = []
        for q, _, _ in mine:
            for rank, sim in enumerate(sorted((round(rng.uniform(-0.2, 1), 2) for _ in range(8)), reverse=True), 1):
                found.append((q, rng.randrange(6), sim, rank))
        expected[target] = model_recall(mine, found)
        queries += [(target, "target_1", q, k, i, w) for i, (q, k, w) in enumerate(mine)]
        hits += [(target, "target_1", q, 100 * jd + r, jd, r, s) for q, jd, s, r in found]
    q = spark.createDataFrame(queries, "resume_id long, target_id string, query_id string, query_type string, query_order int, weight double")
    h = spark.createDataFrame(hits, "resume_id long, target_id string, query_id string, chunk_id long, jd_id long, chunk_rank int, similarity double")
    weighted = recall.with_effective_weights(q)
    evidence = recall.query_evidence(recall.best_chunk_per_query(h), weighted)
    candidates = recall.recall_candidates(evidence)
    got = defaultdict(dict)
    for r in candidates.collect():
        got[r.resume_id][r.jd_id] = (r.aggregate_score, r.title_query_similarity, r.weighted_query_coverage)
        assert 0 <= r.weighted_query_coverage <= 1
    for target, jds in expected.items():
        assert got[target].keys() == jds.keys()
        for jd, scores in jds.items():
            assert got[target][jd] == pytest.approx(scores, nan_ok=True) if scores[1] is not None else (
                got[target][jd][1] is None and got[target][jd][0] == pytest.approx(scores[0]))
    breakdown = recall.type_breakdown(candidates, evidence, recall.type_weight_plan(weighted))
    assert recall.check_contribution_sum(candidates, breakdown).where("NOT consistent").count() == 0
    ranks = recall.ranked_candidates(candidates, 3)
    assert ranks.groupBy("resume_id").agg(F.max("recall_rank").alias("m"), F.count("*").alias("n")).where("m <> n OR n > 3").count() == 0


def test_missing_title_similarity_sorts_last(spark):
    rows = [(1, "t", 1, 0.5, None, 1.0, 0.5, 1), (1, "t", 2, 0.5, 0.1, 0.2, 0.5, 2), (1, "t", 3, 0.5, 0.1, 0.2, 0.5, 1)]
    df = spark.createDataFrame(rows, "resume_id long, target_id string, jd_id long, aggregate_score double, "
                               "title_query_similarity double, weighted_query_coverage double, best_similarity double, first_seen long")
    assert [r.jd_id for r in recall.ranked_candidates(df, 10).orderBy("recall_rank").collect()] == [3, 2, 1]


def packed(header, lines, limit):
    """Plain packing loop used as the expectation."""
    out, body = [], []
    for line in (x[:limit].rstrip() for x in lines):
        if body and len("\n".join([header, *body, line])) > limit:
            out.append(body)
            body = []
        body.append(line)
    return ["\n".join([header, *b])[:limit].rstrip() for b in [*out, body] if b]


def test_passages_are_packed_line_by_line(spark):
    rng = random.Random(1)
    tasks = [f"{i} " + "w" * rng.choice([3, 30, 200, 1300]) for i in range(40)]
    kind = f"array<{RESPONSIBILITY.simpleString()}>"
    row = [(1, " Lead  dev", "", [(1, "do it", tasks, None), (2, " ", [], None)], None, " ", "3 y", ["c", "c", " d "]),
           (2, "Plain", None, None, None, None, None, None), (None, "X", None, None, None, None, None, None), (4, " ", None, None, None, None, None, None)]
    jd = spark.createDataFrame(row, f"id long, job_title string, department string, responsibilities {kind}, minimum_education string, "
                               "education_background string, work_experience_raw string, competencies array<string>")
    got = {r.jd_id: [(p.section, p.text) for p in r.passages] for r in passages.jd_documents(jd).collect()}
    header = "公司岗位名称：Lead dev"
    duty = packed(header, ["岗位职责：do it"] + ["具体任务：" + t for t in tasks], 1200)
    assert got[1] == (
        [("qualification_part_0", header + "\n工作经验要求：3 y")]
        + [(f"responsibility_0_part_{i}", t) for i, t in enumerate(duty)]
        + [("competency_part_0", header + "\n胜任能力：c\n胜任能力：d")])
    assert got[2] == [("title_only", "公司岗位名称：Plain")] and set(got) == {1, 2}
    assert {(r.id, r.reason) for r in passages.jd_build_rejects(jd).collect()} == {(None, "missing_id"), (4, "missing_job_title")}
    chosen = {(r.jd_id, r.query_type): [c.section for c in r.chosen] for r in rerank.document_passages(passages.jd_documents(jd)).collect()}
    assert chosen[1, WORK][0] == "qualification_part_0" and len(chosen[1, WORK]) == 12
    assert chosen[1, SKILLS][0] == "competency_part_0" and chosen[2, PROJECT] == ["title_only"]


def test_query_units_of_a_bare_resume(spark):
    resume = spark.createDataFrame([(1, None, None, None, ([], [], []), None)], RESUME_WITH_ID())
    targets = spark.createDataFrame([(1, "target_1", " Lead 　dev ")], "resume_id long, target_id string, requested_job_title string")
    row = query_units.unit_arrays(targets, resume).first()
    assert [u.text for u in row.units] == ["申请岗位：Lead dev"]
    assert row.warnings == [query_units.NO_WORK, query_units.NO_PROJECT, query_units.NO_SKILLS, query_units.ONLY_TITLE]


def test_long_evidence_is_cut(spark):
    work = (None, "t", None, None, None, ["x" * 3000], [], [])
    resume = spark.createDataFrame([(1, None, None, None, ([], [work, work], []), None)], RESUME_WITH_ID())
    targets = spark.createDataFrame([(1, "target_1", "T")], "resume_id long, target_id string, requested_job_title string")
    units = query_units.query_units(targets, resume).orderBy("query_order").collect()
    assert [u.query_id for u in units] == ["target_1:title", "target_1:work_0"]  # equal texts once
    assert len(units[1].text) == len(units[1].resume_evidence_text) == 1500


def RESUME_WITH_ID():
    from pyspark.sql import types as T

    return T.StructType([T.StructField("resume_id", T.LongType()), *RESUME.fields])


CANDIDATE = "resume_id long, target_id string, jd_id long, recall_rank int, job_title string, department string, title_similarity double, resume_support_score double, aggregate_score double"


def decide(spark, scores, cfg):
    """Decision for one target whose candidates have the given (title, support, recall) scores."""
    rows = [(1, "t", i, i, f"J{i}", None, a, 0.0, c) for i, (a, b, c) in enumerate(scores, 1)]
    recalled = spark.createDataFrame(rows, CANDIDATE).drop("resume_support_score")
    types = spark.createDataFrame([(1, "t", i, b) for i, (a, b, c) in enumerate(scores, 1)],
                                  "resume_id long, target_id string, jd_id long, weighted_contribution double")
    ranked = rerank.ranked_rerank(rerank.rerank_candidates(recalled, types, cfg), cfg)
    targets = spark.createDataFrame([(1, "t")], "resume_id long, target_id string")
    return rerank.rerank_decision(targets, recalled, recalled.where("false"), ranked, cfg).first()


AUTO = dict(require_manual_confirmation=False)


@pytest.mark.parametrize("scores,options,status,recommended,warning", [
    ([], {}, "no_candidate", None, rerank.NO_RECALL),
    ([(0.9, 0.9, 0.9), (0.1, 0.1, 0.1)], {}, "needs_confirmation", 1, rerank.MANUAL_NEEDED),
    ([(0.9, 0.9, 0.9), (0.1, 0.1, 0.1)], AUTO, "auto_resolved", 1, None),
    ([(0.9, 0.9, 0.9)], AUTO, "auto_resolved", 1, None),
    ([(0.9, 0.9, 0.9), (0.89, 0.9, 0.9)], AUTO, "needs_confirmation", 1, rerank.MARGIN_LOW),
    ([(0.5, 0.9, 0.9)], AUTO, "needs_confirmation", 1, rerank.SCORE_LOW),
    ([(0.5, 0.9, 0.9)], dict(minimum_title_similarity=0.6), "no_eligible_candidate", None, rerank.NONE_ELIGIBLE),
    ([(0.5, 1.0, 1.0), (0.7, 0.0, 0.0)], dict(minimum_title_similarity=0.6), "needs_confirmation", 2, rerank.MANUAL_NEEDED),
])
def test_decisions(spark, scores, options, status, recommended, warning):
    got = decide(spark, scores, RerankConfig(**options))
    assert (got.status, got.recommended_jd_id) == (status, recommended)
    assert got.decision_warnings == ([warning] if warning else [])
    assert got.needs_confirmation == (status in ("needs_confirmation", "no_eligible_candidate"))
    assert got.selected_jd_id == (recommended if status == "auto_resolved" else None)


def test_recall_config_keeps_weights():
    assert RecallConfig().type_weights[TITLE] == 0.40


def test_a_search_task_holds_few_copies_of_its_vectors():
    """8,000 queries and 32,000 chunks of 16 numbers are 2.6 MB in single precision; all else is hits and what one strip of queries needs."""
    rng = np.random.default_rng(1)

    def vectors(n):
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="int32") * 16), pa.array(rng.standard_normal(n * 16, dtype="float32")))

    asked = pa.table({"resume_id": np.arange(8000), "target_id": ["t"] * 8000, "query_id": [str(i) for i in range(8000)], "embedding": vectors(8000)})
    held = pa.table({"chunk_id": np.arange(32000), "jd_id": np.arange(32000), "embedding": vectors(32000), "cell": np.arange(32000, dtype="int32") % 4})
    search = similarity._search(5, 16, 8192, SimpleNamespace(value=rng.standard_normal((4, 16))))
    tracemalloc.start()
    try:
        hits = search(asked, held)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert hits.num_rows == 8000
    assert peak < 80e6  # 106 MB when strips were twice as long and queries were held in two precisions


POOL = pa.proxy_memory_pool(pa.default_memory_pool())  # outlives what is taken from it


def test_a_search_task_sorts_numbers_not_vectors():
    """10 MB of chunk vectors, of which some have equal ids, meet few queries: Arrow copies none of them."""
    rng = np.random.default_rng(2)

    def vectors(n):
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="int32") * 64), pa.array(rng.standard_normal(n * 64, dtype="float32")))

    n = 40_000
    ids = rng.permutation(n)
    asked = pa.table({"resume_id": np.arange(20), "target_id": ["t"] * 20, "query_id": [str(i) for i in range(20)], "embedding": vectors(20)})
    held = pa.table({"chunk_id": ids // 2, "jd_id": ids, "embedding": vectors(n), "cell": ids.astype("int32") % 4})
    search = similarity._search(5, 64, 8192, SimpleNamespace(value=rng.standard_normal((4, 64))))
    before = pa.default_memory_pool()
    pa.set_memory_pool(POOL)
    try:
        hits = search(asked, held)
    finally:
        pa.set_memory_pool(before)
    unit = [np.stack(t["embedding"].to_pylist()) for t in (asked, held)]
    unit = [v / np.sqrt((v * v).sum(axis=1))[:, None] for v in unit]
    distance = np.round(1 - unit[0] @ unit[1].T, 12)
    for row in hits.to_pylist():
        own = distance[int(row["query_id"])]
        best = np.lexsort((ids // 2, own))[:5]
        found = sorted((round(h["distance"], 9), h["chunk_id"], h["jd_id"]) for h in row["hits"])
        assert found == [(round(own[i], 9), ids[i] // 2, ids[i]) for i in best]
    assert POOL.max_memory() < 8e6
