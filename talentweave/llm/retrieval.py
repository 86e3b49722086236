"""Ranked lexical search: the best documents for each query, exactly, by ball trees over sparse vectors.

A document is a sparse vector with, for each term, what an occurrence adds to a score (integers); a query has the weights of its terms. The
score is their inner product. Only terms of queries matter, so documents are stored with the counts of those.
Each task cuts its documents into slabs and builds a ball tree over each: a node has the centroid of its
documents and a radius around it for each of ``GROUPS`` groups of terms. No document of a node scores above <query, centroid> + sum over groups of
|query in group| * radius, where groups without a query's terms add nothing; all parts are rounded up. Nodes are visited best first until the highest bound left is below the last score that is kept; documents of visited
leaves are scored in 64-bit integers. The best of all tasks meet in one ranking. Vectors are scaled by the weights of terms, which leaves
inner products as they are and keeps frequent terms from widening the balls.

Queries are taken in blocks of bounded size, each by one pass over the documents. Every row of queries is a query of its own, also where ids
repeat; queries that share no term with any document have no rows. NULL texts have no terms. Rows of documents that repeat are ranked one by one; a
NULL id comes after all others of the same score.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentweave.llm.spans import byte_table, spans, term_array
from talentweave.llm.words import slices
from talentweave.plans.storage import materialize

TOP = 20
LEAF_ROWS = 32
SLAB_ROWS = 4096
GROUPS = 512
CELLS = 1 << 22  # nodes times terms of one tree
BLOCK_QUERIES = 10_000  # a block has about so many queries
SAFE = 1e-9  # far above the rounding errors of sums of doubles

TERMS = byte_table(digits=True)
COUNT_FIELDS = "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"
HIT_FIELDS = "query bigint, item_id bigint, doc_id bigint, score bigint"


def terms_of(text: str | None) -> list[str]:
    """All terms of a text, in order."""
    mapped, _, lengths, _ = spans(pa.array([text or ""]), TERMS)
    return [t.decode() for t in term_array(mapped, lengths).to_pylist()]


def _count(vocabulary: pa.Array):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in slices(batch.column("text")):
                mapped, _, lengths, doc = spans(pc.fill_null(texts, ""), TERMS)
                number = pc.index_in(term_array(mapped, lengths), value_set=vocabulary)
                known = number.is_valid().to_numpy(zero_copy_only=False)
                keys, counts = np.unique(doc[known] * len(vocabulary) + number.drop_null().to_numpy(), return_counts=True)
                ends = pa.array(np.searchsorted(keys, np.arange(len(texts) + 1) * len(vocabulary)).astype("int32"))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(done, len(texts)), pa.array(np.bincount(doc, minlength=len(texts))),
                    pa.ListArray.from_arrays(ends, pa.array((keys % max(1, len(vocabulary))).astype("int32"))),
                    pa.ListArray.from_arrays(ends, pa.array(counts))], ["doc_id", "n", "terms", "counts"])
                done += len(texts)

    return count


class BallTree:
    """A ball tree over rows of sparse vectors, none of them empty: ``index`` and ``value`` of their entries, ``ends`` of rows (first 0)."""

    def __init__(self, index: np.ndarray, value: np.ndarray, ends: np.ndarray, weight: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.index, self.value, self.ends, self.leaf_rows = index.copy(), value.copy(), ends.copy(), leaf_rows
        self.weight, self.rows = weight.astype("float64"), np.arange(len(ends) - 1)
        self.spans, self.children, self.centres, self.radii = [], [], [], []
        self.scaled = value * self.weight[index]
        self.group = np.arange(len(weight)) % GROUPS
        self.squares = np.add.reduceat(self.scaled * self.scaled, ends[:-1])
        self._grow(0, len(self.rows))
        self.centres, self.radii = np.stack(self.centres), np.stack(self.radii)

    def _distances(self, low: int, high: int, point: np.ndarray) -> np.ndarray:
        """Squared distances of rows to a point."""
        a, b = self.ends[low], self.ends[high]
        dots = np.add.reduceat(self.scaled[a:b] * point[self.index[a:b]], self.ends[low:high] - a)
        return self.squares[low:high] - 2 * dots + point @ point

    def _point(self, row: int) -> np.ndarray:
        point = np.zeros(len(self.weight))
        point[self.index[self.ends[row]:self.ends[row + 1]]] = self.scaled[self.ends[row]:self.ends[row + 1]]
        return point

    def _grow(self, low: int, high: int) -> int:
        node, n = len(self.spans), high - low
        a, b = self.ends[low], self.ends[high]
        centre = np.bincount(self.index[a:b], self.scaled[a:b], len(self.weight)) / n
        far = self._distances(low, high, centre)
        self.spans.append((low, high))
        self.children.append(None)
        self.centres.append(centre)
        self.radii.append(self._radii(low, high, centre))
        if n > self.leaf_rows:
            one = low + int(far.argmax())
            from_one = self._distances(low, high, self._point(one))
            from_other = self._distances(low, high, self._point(low + int(from_one.argmax())))
            side = from_other < from_one
            if not n <= 8 * side.sum() <= 7 * n:  # too uneven: halves instead
                side = np.zeros(n, bool)
                side[np.argsort(from_one - from_other, kind="stable")[n // 2:]] = True
            cut = low + int(n - side.sum())
            self._reorder(low, high, np.argsort(side, kind="stable"))
            self.children[node] = self._grow(low, cut), self._grow(cut, high)
        return node

    def _radii(self, low: int, high: int, centre: np.ndarray) -> np.ndarray:
        """Of each group of terms the largest distance of a row to the centre, rounded up."""
        a, b = self.ends[low], self.ends[high]
        index, x = self.index[a:b], self.scaled[a:b]
        cell = np.repeat(np.arange(high - low), np.diff(self.ends[low:high + 1])) * GROUPS + self.group[index]
        off, size = (np.bincount(cell, v, (high - low) * GROUPS).reshape(-1, GROUPS) for v in (x * x - 2 * x * centre[index], x * x))
        middle = np.bincount(self.group, centre * centre, GROUPS)
        return np.sqrt((np.maximum(off + middle, 0) + SAFE * (size + middle)).max(axis=0)) * (1 + SAFE)

    def _reorder(self, low: int, high: int, order: np.ndarray) -> None:
        a, b = self.ends[low], self.ends[high]
        lengths = np.diff(self.ends[low:high + 1])[order]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        take = np.arange(b - a) + np.repeat(self.ends[low:high][order] - ends[:-1], lengths)
        for values in (self.index, self.value, self.scaled):
            values[a:b] = values[take]
        self.squares[low:high], self.rows[low:high] = self.squares[low:high][order], self.rows[low:high][order]
        self.ends[low:high + 1] = a + ends

    def bounds(self, terms: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """Of each node a number that no score in it exceeds."""
        groups, owner = np.unique(self.group[terms], return_inverse=True)
        lengths = np.sqrt(np.bincount(owner, repeats * repeats))
        return (self.centres[:, terms] @ repeats + self.radii[:, groups] @ lengths) * (1 + SAFE) + 1

    def scores(self, node: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a leaf and their exact scores; ``query`` has an integer for each term."""
        low, high = self.spans[node]
        a, b = self.ends[low], self.ends[high]
        return self.rows[low:high], np.add.reduceat(self.value[a:b] * query[self.index[a:b]], self.ends[low:high] - a)

    def search(self, terms: np.ndarray, repeats: np.ndarray, ids: list, best: list[tuple], top: int) -> int:
        """Put this tree's rows into ``best``, the sorted (-score, no id, id) of what is kept so far. Returns the number of rows scored."""
        bounds = self.bounds(terms, repeats.astype("float64")).tolist()
        query = np.zeros(len(self.weight), "int64")
        query[terms] = repeats * self.weight[terms].astype("int64")
        queue, scored = [(-bounds[0], 0)], 0
        while queue:
            bound, node = heapq.heappop(queue)
            least = -best[top - 1][0] if len(best) >= top else 1
            if -bound < least:
                break
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-bounds[child], child))
                continue
            rows, found = self.scores(node, query)
            scored += len(rows)
            good = found >= least
            if good.any():
                best += [(-s, ids[r] is None, ids[r] or 0) for r, s in zip(rows[good].tolist(), found[good].tolist())]
                best.sort()
                del best[top:]
        return scored


def _search(queries: list[tuple], weight: np.ndarray, top: int):
    """``queries`` are (number, id, terms, repeats)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]
        step = max(8 * LEAF_ROWS, min(SLAB_ROWS, CELLS * LEAF_ROWS // (8 * max(1, len(weight)))))
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.slice(start, step)
                part = part.filter(pc.greater(pc.list_value_length(part.column("terms")), 0))
                if not len(part):
                    continue
                index = part.column("terms").flatten().to_numpy().astype("int64")
                counts = part.column("counts").flatten().to_numpy()
                lengths = pc.list_value_length(part.column("terms")).to_numpy().astype("int64")
                m = np.repeat(part.column("m").to_numpy(), lengths)
                value = 1_000_000_000 * counts // (1000 * counts + 12 * m)
                tree = BallTree(index, value, np.concatenate([[0], np.cumsum(lengths)]), weight)
                ids = part.column("doc_id").to_pylist()
                for kept, (_, _, terms, repeats) in zip(best, queries):
                    tree.search(terms, repeats, ids, kept, top)
        rows = [(q[0], q[1], None if no_id else own, -s) for q, kept in zip(queries, best) for s, no_id, own in kept]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["query", "item_id", "doc_id", "score"])

    return search


def _block(docs: DataFrame, rows: list, top: int) -> DataFrame:
    """Rows ``query, item_id, doc_id, score`` for the queries in ``rows``: up to ``top`` of each task."""
    spark = docs.sparkSession
    asked = [(r["query"], r["item_id"], Counter(terms_of(r["text"]))) for r in rows]
    names = sorted({t for *_, found in asked for t in found})
    counted = materialize(docs.mapInArrow(_count(pa.array([t.encode() for t in names], pa.large_binary())), COUNT_FIELDS), "term-frequencies")
    size = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    in_docs = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # one row per term of the block
    weight = np.array([math.floor(1000 * math.log((2 * size.docs + 2) / (2 * in_docs.get(i, 0) + 1))) for i in range(len(names))], "int64")
    place = {t: i for i, t in enumerate(names)}
    queries = []
    for number, own, found in asked:
        terms = [t for t in found if place[t] in in_docs]
        queries.append((number, own, np.array([place[t] for t in terms], "int64"), np.array([found[t] for t in terms], "int64")))
    whole = F.lit(25 * size.docs).cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")
    m = F.lit(75) + F.call_function("div", whole, F.lit(max(1, size.terms or 0)).cast("decimal(20,0)"))
    return counted.select("doc_id", "terms", "counts", m.cast("long").alias("m")).mapInArrow(
        _search([q for q in queries if len(q[2])], weight, top), HIT_FIELDS)


def ranked(
    docs: DataFrame, queries: DataFrame, top: int = TOP, block_queries: int = BLOCK_QUERIES,
    id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: of each query the ``top`` documents with a score above 0, equal scores by id."""
    asked = queries.select(
        F.monotonically_increasing_id().alias("query"), F.col(f"`{query_id_col}`").cast("long").alias("item_id"), F.col(f"`{query_text_col}`").alias("text"))
    asked = materialize(asked, "queries")
    blocks = max(1, -(-asked.count() // block_queries))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    hits = []
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k).collect()
        hits.append(materialize(_block(rows, block, top), "hits"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = reduce(DataFrame.unionByName, hits).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return found.select("item_id", "rank", "doc_id", "score")
