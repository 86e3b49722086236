"""Recall over lists: the hits of a target's queries and its candidates are arrays of a row, judged many rows at a time.

As rows there are (queries x top_k) of them, and grouping and sorting them costs more than all that is done with them. What is judged at
a time is bounded by ``PART_ROWS``, or is one longer list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

PART_ROWS = 1 << 18  # elements of lists at a time
NEAR = 1e-9  # scores that differ by less may be in another order once they are rounded
CANDIDATES = (
    "array<struct<jd_id:bigint,title_query_similarity:double,best_similarity:double,evidence_score:double,_matched:double,_penalty:double,"
    "total_query_count:bigint,matched_query_count:bigint,chunk_hit_count:bigint,first_seen:struct<query_order:int,chunk_rank:int>,"
    "aggregate_score:double>>"
)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype("int64")


def _parts(lists: pa.Array, sizes: np.ndarray) -> Iterator[pa.Array]:
    """``lists`` in runs of about ``PART_ROWS`` elements."""
    part = (np.cumsum(sizes) - sizes) // PART_ROWS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lists)]
    return (lists.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if a < b)


def _by_parts(lists: pa.Array, sizes: np.ndarray, use: Callable[[pa.Array], pa.Array]) -> pa.Array:
    made = [use(part) for part in _parts(lists, sizes)]
    return pa.concat_arrays(made) if made else use(lists)


def _numbers(rows: pa.Array, name: str, fill) -> tuple[np.ndarray, np.ndarray]:
    """Values of a field, and which are NULL."""
    field = pc.struct_field(rows, name)
    return pc.fill_null(field, fill).to_numpy(zero_copy_only=False), pc.is_null(field).to_numpy(zero_copy_only=False)


def _with_nulls(values: np.ndarray, null: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind, mask=null)


def _as_lists(sizes: np.ndarray, fields: dict[str, pa.Array]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _groups(owner: np.ndarray, jd: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of elements by list and JD, otherwise as they were, and where each (list, JD) starts in it."""
    order = np.lexsort((jd, unknown, owner))
    own, ids, null = owner[order], jd[order], unknown[order]
    first = np.ones(len(order), bool)
    first[1:] = (own[1:] != own[:-1]) | (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    return order, np.flatnonzero(first)


def best_of(hits: pa.Array) -> pa.Array:
    """Of each list of hits by rank, the first of each JD; hits without a JD count as of one JD."""
    sizes = _sizes(hits)
    rows = hits.flatten()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    similarity = 1.0 - pc.struct_field(rows, "distance").to_numpy(zero_copy_only=False)
    jd, unknown = _numbers(rows, "jd_id", 0)
    order, first = _groups(owner, jd, unknown)
    at = order[first]
    return _as_lists(np.bincount(owner[at], minlength=len(sizes)), {
        "jd_id": _with_nulls(jd[at], unknown[at], pa.int64()), "chunk_rank": pa.array(rank[at], pa.int32()),
        "similarity": pa.array(similarity[at], pa.float64()),
        "chunk_hits": pa.array(np.diff(np.append(first, len(order))), pa.int64())})


def candidates_of(evidence: pa.Array, best_weight: float) -> pa.Array:
    """Of the queries of each target with their hits, the scores of every JD."""
    n_queries = _sizes(evidence)
    queries = evidence.flatten()
    best = best_of(pc.struct_field(queries, "hits"))
    sizes = _sizes(best)
    rows = best.flatten()
    query = np.repeat(np.arange(len(sizes)), sizes)
    target = np.repeat(np.arange(len(n_queries)), n_queries)[query]
    jd, unknown = _numbers(rows, "jd_id", 0)
    order, first = _groups(target, jd, unknown)
    query, lead = query[order], order[first]
    similarity = pc.struct_field(rows, "similarity").to_numpy(zero_copy_only=False)[order]

    def reduced(use: np.ufunc, values: np.ndarray) -> np.ndarray:
        return use.reduceat(values, first) if len(first) else values[:0]

    def total(values: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return reduced(np.add, np.where(null, 0.0, values)), reduced(np.logical_and, null)

    weight, no_weight = (x[query] for x in _numbers(queries, "effective_weight", 0.0))
    penalty, no_penalty = (x[query[first]] for x in _numbers(queries, "penalty", 0.0))
    titled = _numbers(queries, "is_title", False)[0].astype(bool)[query]
    highest, title = reduced(np.maximum, similarity), reduced(np.maximum, np.where(titled, similarity, -np.inf))
    score, no_score = total(similarity * weight, no_weight)
    matched, no_matched = total(weight, no_weight)
    # The least (query_order, chunk_rank): NULL comes first.
    place, no_place = (x[query] for x in _numbers(queries, "query_order", 0))
    rank = pc.struct_field(rows, "chunk_rank").to_numpy(zero_copy_only=False)[order]
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    seen = np.lexsort((rank, place, ~no_place, group))[first] if len(first) else first
    return _as_lists(np.bincount(target[lead], minlength=len(n_queries)), {
        "jd_id": _with_nulls(jd[lead], unknown[lead], pa.int64()),
        "title_query_similarity": _with_nulls(title, title == -np.inf, pa.float64()), "best_similarity": pa.array(highest, pa.float64()),
        "evidence_score": _with_nulls(score, no_score, pa.float64()), "_matched": _with_nulls(matched, no_matched, pa.float64()),
        "_penalty": _with_nulls(penalty, no_penalty, pa.float64()),
        "total_query_count": pc.struct_field(queries, "n_queries").take(pa.array(query[first])),
        "matched_query_count": pa.array(np.diff(np.append(first, len(order))), pa.int64()),
        "chunk_hit_count": pa.array(reduced(np.add, pc.struct_field(rows, "chunk_hits").to_numpy(zero_copy_only=False)[order]), pa.int64()),
        "first_seen": pa.StructArray.from_arrays(
            [_with_nulls(place[seen], no_place[seen], pa.int32()), pa.array(rank[seen], pa.int32())], ["query_order", "chunk_rank"]),
        "aggregate_score": _with_nulls(highest * best_weight + score * (1.0 - best_weight), no_score, pa.float64())})


def foremost(candidates: pa.Array, top_n: int) -> pa.Array:
    """Each list without the candidates that can't be among its ``top_n`` best: their score is clearly below that of ``top_n`` others."""
    sizes = _sizes(candidates)
    rows = candidates.flatten()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    score, null = _numbers(rows, "aggregate_score", np.nan)
    unclear = np.bincount(owner, weights=~np.isfinite(score), minlength=len(sizes)) > 0  # such lists are left whole
    order = np.lexsort((-np.where(np.isfinite(score), score, 0.0), owner))
    starts = np.cumsum(sizes) - sizes
    last = np.where((sizes >= top_n) & ~unclear, starts + top_n - 1, -1)
    floor = np.full(len(sizes), -np.inf)
    floor[last >= 0] = score[order[last[last >= 0]]] - NEAR
    keep = np.flatnonzero(~(score < floor[owner]))
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(sizes)))]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), rows.take(pa.array(keep)))


def list_candidates(best_weight: float):
    @F.arrow_udf(CANDIDATES)
    def candidates(evidence: pa.Array) -> pa.Array:
        hits = pc.struct_field(evidence.flatten(), "hits")
        rows = np.concatenate([[0], np.cumsum(_sizes(hits))])[np.concatenate([[0], np.cumsum(_sizes(evidence))])]
        return _by_parts(evidence, np.diff(rows), lambda part: candidates_of(part, best_weight))

    return candidates


def list_foremost(top_n: int):
    @F.arrow_udf(CANDIDATES)
    def near(candidates: pa.Array) -> pa.Array:
        return _by_parts(candidates, _sizes(candidates), lambda part: foremost(part, top_n))

    return near
