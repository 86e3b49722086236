"""Recall over lists of hits gives what recall over rows gives; evidence is shortened before it meets JDs."""

import random

import pytest
from pyspark.sql import functions as F

from talentweave.config import TITLE, RecallConfig
from talentweave.functions.scorers import JaccardScorer, ModelScorer
from talentweave.operators import recall, recall_lists, rerank, similarity

HITS = "resume_id long, target_id string, query_id string, hits array<struct<distance:double,chunk_id:long,jd_id:long>>"
UNITS = "resume_id long, target_id string, query_id string, query_type string, query_order int, weight double"


def _plain(df):
    return sorted(str([round(x, 10) if isinstance(x, float) else x for x in r]) for r in df.collect())


@pytest.mark.parametrize("least", [None, 0.4])
def test_lists_give_what_rows_give(spark, monkeypatch, least):
    monkeypatch.setattr(recall_lists, "PART_ROWS", 50)
    rng = random.Random(5)
    data = []
    for t in range(30):
        for q in range(4):
            far = sorted(round(rng.random() * 1.2, 2) for _ in range(rng.randint(0, 25)))
            data.append((t, None if t == 3 else "a", f"q{q}", [(x, rng.randint(0, 40), rng.choice([None, *range(12)])) for x in far]))
    lists = spark.createDataFrame(data, HITS)
    rows = lists.select("resume_id", "target_id", "query_id", F.posexplode("hits").alias("r", "h")).select(
        "resume_id", "target_id", "query_id", "h.chunk_id", "h.jd_id", "h.distance", (F.col("r") + 1).alias("chunk_rank"), (1 - F.col("h.distance")).alias("similarity"))
    # A repeated query, kinds without a weight, queries without a weight or a place.
    units = [(t, "a", f"q{q % 4}", rng.choice([TITLE, "skills", "odd", None]), rng.choice([None, q]), rng.choice([1.0 + q, None])) for t in range(30) for q in range(5)]
    cfg = RecallConfig(minimum_similarity=least)
    weighted = recall.with_effective_weights(spark.createDataFrame(units, UNITS), cfg)
    by_row, by_list = (
        recall.recall_candidates(recall.query_evidence(recall.best_chunk_per_query(h, cfg), weighted), cfg) for h in (rows, lists))
    assert by_list.columns == ["resume_id", "target_id", "candidates"]
    for top_n in (1, 4, 100):
        wanted = recall.ranked_candidates(by_row, top_n)
        got = recall.ranked_candidates(by_list, top_n).select(wanted.columns)
        assert _plain(got) == _plain(wanted) and got.count() > 20


def test_only_candidates_that_can_be_kept_become_rows():
    import pyarrow as pa

    kind = pa.list_(pa.struct([("aggregate_score", pa.float64()), ("jd_id", pa.int64())]))
    lists = [[{"aggregate_score": s, "jd_id": i} for i, s in enumerate(scores)] for scores in (
        [0.1, 0.9, 0.5, 0.5 - 1e-13, 0.2], [], [0.3], [0.1, None, 0.5, 0.6], [0.4, 0.3, 0.2])]
    kept = recall_lists.foremost(pa.array(lists, kind), 2).to_pylist()
    assert [[c["jd_id"] for c in row] for row in kept] == [[1, 2, 3], [], [0], [0, 1, 2, 3], [0, 1]]


def test_hits_in_lists_are_those_in_rows(spark):
    rng = random.Random(2)
    vector = lambda: [rng.gauss(0, 1) for _ in range(4)]
    queries = spark.createDataFrame([(i // 3, "a", f"q{i % 3}", vector()) for i in range(30)], "resume_id long, target_id string, query_id string, embedding array<float>")
    chunks = spark.createDataFrame(
        [(i, i // 4, "x", True, vector()) for i in range(80)], "chunk_id long, jd_id long, chunk_type string, is_embedding_target boolean, embedding array<float>")
    rows = similarity.nearest_chunks(queries, chunks, top_k=7, dim=4, block_rows=16)
    lists = similarity.nearest_chunks(queries, chunks, top_k=7, dim=4, block_rows=16, as_lists=True)
    assert lists.count() == 30
    out = lists.select("resume_id", "target_id", "query_id", F.posexplode("hits").alias("r", "h")).select(
        "resume_id", "target_id", "query_id", "h.chunk_id", "h.jd_id", "h.distance", (F.col("r") + 1).alias("chunk_rank"))
    assert _plain(out) == _plain(rows.select(out.columns))


def test_evidence_is_aggregated_without_a_sort(spark):
    evidence = spark.createDataFrame(
        [(1, "a", 7, TITLE, 1, None, 0.5, 1.0, 0.25, 0.2, 1, 3), (1, "a", 7, "skills", 1, 2, 0.5, 1.0, 0.25, 0.2, 1, 1), (1, "a", 8, "skills", -1, 5, 0.5, 1.0, 0.25, 0.2, 1, 4),
         (1, "a", 8, "skills", -1, 2, 0.5, 1.0, 0.25, 0.2, 1, 9)],
        "resume_id long, target_id string, jd_id long, query_type string, n_queries int, query_order int, similarity double, penalty double, effective_weight double, "
        "weighted_similarity double, chunk_hits int, chunk_rank int")
    found = recall.recall_candidates(evidence)
    assert {r.jd_id: tuple(r.first_seen) for r in found.collect()} == {7: (None, 3), 8: (2, 9)}
    assert "SortAggregate" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("scorer", [JaccardScorer(), ModelScorer(lambda: None, "none")])
def test_shortened_evidence_is_prepared_evidence(spark, scorer):
    texts = spark.createDataFrame([("A b\t a  C　Ä b",), ("  ",), ("x",), (None,), ("",)], "t string")
    got = texts.select(scorer.prepare(F.col("t")).alias("whole"), scorer.expand(scorer.shorten(F.col("t"))).alias("steps")).collect()
    assert [r.whole for r in got] == [r.steps for r in got]


def test_evidence_is_tokenised_before_it_meets_jds(spark):
    recalled = spark.createDataFrame([(1, "a", 5), (1, "a", 6)], "resume_id long, target_id string, jd_id long")
    queries = spark.createDataFrame([(1, "a", "q1", "skills", 1, "Go  Rust go")], "resume_id long, target_id string, query_id string, query_type string, query_order int, resume_evidence_text string")
    documents = spark.createDataFrame([(5, [("competency_part_0", "rust")]), (6, [("competency_part_0", "java go")])], "jd_id long, passages array<struct<section:string,text:string>>")
    scored = rerank.score_pairs(rerank.support_pairs(recalled, queries, documents, scorer=JaccardScorer()))
    assert {r.jd_id: r.score for r in scored.collect()} == {5: 0.5, 6: 1 / 3}
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Join")]
    assert "regexp_replace(left_text" not in above and "regexp_replace(resume_evidence_text" in plan


@pytest.mark.parametrize("waiting", [1, 1 << 18])
def test_hits_are_measured_once_per_strip(monkeypatch, waiting):
    """Of 40 panels few pairs are measured, whatever waits; ties go to the lesser rank."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(similarity, "PANEL_ROWS", 50)
    monkeypatch.setattr(similarity, "WAITING_PAIRS", waiting)
    rng = np.random.default_rng(3)
    raw = rng.normal(size=(2000, 8)).astype("float32")
    raw[1500:1700] = raw[100]  # one vector many times
    asked = np.concatenate([rng.normal(size=(40, 8)), raw[100:101]]).astype("float32")

    def vectors(rows):
        return similarity._Vectors(pa.chunked_array([pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), 8).cast(pa.list_(pa.float32()))]), 8)

    measured, of = [], similarity._measured
    monkeypatch.setattr(similarity, "_measured", lambda a, r, h, c: measured.append(len(r)) or of(a, r, h, c))
    rank = rng.permutation(2000)
    distances, places = similarity._best(vectors(asked), vectors(raw), np.arange(2000) // 100, rank, np.zeros(2000, "int64"), 9, 50, None)
    unit = [x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1, keepdims=True) for x in (asked, raw)]
    exact = np.round(1.0 - unit[0] @ unit[1].T, 12) + 0.0
    for i, row in enumerate(exact):
        best = np.lexsort((rank, row))[:9]
        assert places[i].tolist() == best.tolist() and np.allclose(distances[i], row[best], atol=1e-12)
    if waiting > 1:
        assert sum(measured) < 1500 and len(measured) == 1


@pytest.mark.parametrize("parts", [1, 7, 16, 60])
def test_every_search_task_has_a_partition_of_its_own(spark, parts):
    task = similarity._task_number(spark, F.col("id").cast("int"), parts)
    dealt = spark.range(parts).withColumn("task", task).repartition(parts, "task").select(F.spark_partition_id().alias("p")).distinct().count()
    assert dealt == parts
