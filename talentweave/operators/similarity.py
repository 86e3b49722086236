"""Exact top-k chunks per query vector by cosine distance, by one plan for tables of any size.

Chunks are spread over cells around pivot vectors, of which there are about as many as blocks of chunks. Whole cells, or parts of a
crowded one, are dealt to slabs, and queries to shards; both are bounded in bytes, whatever the size of a block, and a task holds one slab and
one shard. So a query is copied once per slab and a chunk once per shard, however many cells there are, and the numbers of both are chosen so that
few bytes move. Inside a task a strip of queries meets the cells in the order of their angles; the k-th best hit so far and the triangle
inequality on angles decide which cells it needs. Products in single precision tell which chunks can be among the k best, and what is
left of those after the last cell is measured in double precision. A task gives back k hits per query as one row, and rows of a query are merged where its target is, so that
what follows needs no exchange by target. Nothing but pivots and counts per cell comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.config import TARGET_KEYS
from talentweave.functions.rows import explode_rows
from talentweave.plans.storage import materialize

BLOCK_ROWS = 8192  # chunks of a cell on average, if their vectors fit BLOCK_BYTES
BLOCK_BYTES = 1 << 26
PIVOT_BYTES = 1 << 26  # all pivots together; cells beyond that many grow instead
SLAB_BYTES = 1 << 25  # vectors of the chunks of a task
SHARD_BYTES = 1 << 26  # vectors and hits of the queries of a task
PANEL_ROWS = 8192  # chunks multiplied at a time inside a task
STRIP_ROWS = 256  # queries multiplied at a time inside a task
EXACT_ROWS = 1 << 14  # pairs measured in double precision at a time
WAITING_PAIRS = 1 << 18  # pairs that wait to be measured
TASK_PAIRS = 1 << 22  # a search of so many pairs isn't split further
ANGLE_SLACK = 1e-6
LISTED_TASKS = 1 << 10  # of so many tasks each has a partition of its own
MAX_PARTITIONS = 1 << 16  # beyond it a task gets several slabs and shards, one after another
QUERY_KEYS = [*TARGET_KEYS, "query_id"]
HIT = "struct<distance:double,chunk_id:bigint,jd_id:bigint>"


def embeddable(chunks: DataFrame, chunk_types: Sequence[str] | None = None) -> DataFrame:
    """Chunks that may be recalled; an empty list of types means all types."""
    kept = chunks.where(F.col("is_embedding_target") & F.col("embedding").isNotNull())
    types = list(dict.fromkeys(t.strip() for t in chunk_types or [] if t.strip()))
    return kept.where(F.col("chunk_type").isin(types)) if types else kept


def _matrix(vectors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the usable rows and the positions of those rows."""
    usable = np.flatnonzero([v is not None and len(v) == dim for v in vectors])
    if not len(usable):
        return np.empty((0, dim)), usable
    rows = np.stack(vectors.to_numpy()[usable]).astype("float64")
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        norms = np.sqrt((rows * rows).sum(axis=1))
        unit = rows / norms[:, None]
    good = np.isfinite(unit).all(axis=1) & np.isfinite(norms)
    return unit[good], usable[good]


class _Vectors:
    """The usable vectors of a column, as they came, and their lengths; a column in one piece isn't copied."""

    def __init__(self, column: pa.ChunkedArray, dim: int):
        usable = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
        rows = column.take(pa.array(usable)) if len(usable) < len(column) else column
        parts = [chunk.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for chunk in rows.chunks]
        raw = parts[0] if len(parts) == 1 else np.concatenate([np.empty((0, dim), "float32"), *parts])
        norms, good = np.empty(len(raw)), np.empty(len(raw), bool)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            for start in range(0, len(raw), PANEL_ROWS):
                part = slice(start, start + PANEL_ROWS)
                own = raw[part].astype("float64")
                norms[part] = np.sqrt((own * own).sum(axis=1))
                own /= norms[part, None]
                good[part] = np.isfinite(own).all(axis=1) & np.isfinite(norms[part])
        if not good.all():
            raw, norms, usable = raw[good], norms[good], usable[good]
        self.raw, self.norms, self.place = raw, norms, usable

    def __len__(self) -> int:
        return len(self.raw)

    def ordered(self, order: np.ndarray) -> _Vectors:
        self.raw, self.norms, self.place = self.raw[order], self.norms[order], self.place[order]
        return self

    def unit(self, rows: np.ndarray | slice) -> np.ndarray:
        return self.raw[rows].astype("float64") / self.norms[rows, None]

    def single(self) -> np.ndarray:
        """All unit vectors in single precision."""
        out = np.empty(self.raw.shape, "float32")
        for start in range(0, len(out), PANEL_ROWS):
            out[start:start + PANEL_ROWS] = self.unit(slice(start, start + PANEL_ROWS))
        return out


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers from each ``low`` up to its ``high``, and the number of the range each is from."""
    counts = high - low
    owner = np.repeat(np.arange(len(low)), counts)
    return np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + low[owner], owner


class _Pieces:
    """Chunks of a slab, ordered by cell, as pieces of one cell each: where they start, their centers and largest angles to them."""

    def __init__(self, vectors: _Vectors, cell: np.ndarray, rows: int):
        first = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1))
        inside = np.arange(len(cell)) - np.repeat(first, np.diff(np.append(first, len(cell))))
        self.starts = np.flatnonzero(inside % rows == 0)
        self.ends = np.append(self.starts[1:], len(cell))
        # Panels: runs of pieces of about PANEL_ROWS chunks
        panel = self.starts // PANEL_ROWS
        cuts = np.flatnonzero(np.diff(panel, prepend=-1))
        self.panels = list(zip(cuts.tolist(), np.append(cuts[1:], len(panel)).tolist()))
        self.centers, self.radii = np.empty((len(self.starts), vectors.raw.shape[1])), np.empty(len(self.starts))
        for a, b in self.panels:
            low, high = self.starts[a], self.ends[b - 1]
            unit = vectors.unit(slice(low, high))
            sums = np.add.reduceat(unit, self.starts[a:b] - low, axis=0)
            with np.errstate(invalid="ignore", divide="ignore"):
                centers = sums / np.sqrt((sums * sums).sum(axis=1))[:, None]
            centers[~np.isfinite(centers).all(axis=1)] = 0.0  # every angle is a right one then
            owner = np.repeat(np.arange(b - a), self.ends[a:b] - self.starts[a:b])
            angle = np.arccos(np.clip((unit * centers[owner]).sum(axis=1), -1.0, 1.0))
            self.centers[a:b] = centers
            self.radii[a:b] = np.where(centers.any(axis=1), np.maximum.reduceat(angle, self.starts[a:b] - low), np.pi)

    def nearest(self, unit: np.ndarray) -> np.ndarray:
        """The least distance at which each query may have a chunk of each piece."""
        angle = np.arccos(np.clip(unit @ self.centers.T, -1.0, 1.0))
        return 1.0 - np.cos(np.maximum(0.0, angle - self.radii - ANGLE_SLACK)) - ANGLE_SLACK


def _measured(asked: _Vectors, rows: np.ndarray, held: _Vectors, columns: np.ndarray) -> np.ndarray:
    """Distances of pairs in double precision: by a product where most of a grid is asked for, else pair by pair."""
    own, row = np.unique(rows, return_inverse=True)
    other, column = np.unique(columns, return_inverse=True)
    if 16 * len(rows) >= len(own) * len(other):
        return np.round(1.0 - (asked.unit(own) @ held.unit(other).T)[row, column], 12) + 0.0
    out = np.empty(len(rows))
    for start in range(0, len(rows), EXACT_ROWS):
        part = slice(start, start + EXACT_ROWS)
        out[part] = np.einsum("ij,ij->i", asked.unit(rows[part]), held.unit(columns[part]))
    return np.round(1.0 - out, 12) + 0.0


class _Rejected:
    """JDs that targets must not meet, as pairs of the number of a target and a JD, by target."""

    def __init__(self, queries: pa.Table):
        number = queries.select(TARGET_KEYS).to_pandas().groupby(TARGET_KEYS, dropna=False, sort=False).ngroup().to_numpy()
        gone = pc.is_valid(queries["forbidden"]).to_numpy(zero_copy_only=False)
        order = np.argsort(number[gone], kind="stable")
        self.target, self.jd = number[gone][order], queries["forbidden"].filter(pa.array(gone)).to_numpy()[order]
        self.of_query = number[~gone]

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the place of a query in ``rows`` and a JD."""
        own = self.of_query[rows]
        at, owner = _ranges(np.searchsorted(self.target, own), np.searchsorted(self.target, own, "right"))
        return owner, self.jd[at]


def _passing(r: np.ndarray, c: np.ndarray, value: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kept = value >= limit[r]
    return r[kept], c[kept], value[kept]


def _settle(waiting: list, limit: np.ndarray, queries: _Vectors, chunks: _Vectors, start: int, rank: np.ndarray, top: np.ndarray, own: np.ndarray) -> None:
    """Measure the pairs that wait in double precision, unless their likeness has fallen below the limit, and merge them into the best hits."""
    if not waiting:
        return
    k = top.shape[1]
    r, c, _ = _passing(*(np.concatenate(x) for x in zip(*waiting)), limit)
    waiting.clear()
    found = _measured(queries, r + start, chunks, c)
    keep = found <= top[r, -1]
    r, c, found = r[keep], c[keep], found[keep]
    rows = np.unique(r)
    old = np.nonzero(np.isfinite(top[rows]))
    r = np.concatenate([rows[old[0]], r])
    found = np.concatenate([top[rows][old], found])
    c = np.concatenate([own[rows][old], rank[c]])
    order = np.lexsort((c, found, r))
    r, c, found = r[order], c[order], found[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    kept = place < k
    top[r[kept], place[kept]], own[r[kept], place[kept]] = found[kept], c[kept]


def _best(queries: _Vectors, chunks: _Vectors, cell: np.ndarray, rank: np.ndarray, jd: np.ndarray, k: int, block_rows: int,
          rejected: _Rejected | None) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ranks of the k nearest chunks of each query, infinite where there are fewer. Chunks are ordered by cell; ``rank`` settles ties."""
    pieces = _Pieces(chunks, cell, min(block_rows, PANEL_ROWS))
    slack = np.float32((queries.raw.shape[1] + 16) * 2.0**-23)  # more than two products in single precision are wrong by
    where = np.empty(len(rank), "int32")
    where[rank] = np.arange(len(rank))
    distances, ranks = np.full((len(queries), k), np.inf), np.zeros((len(queries), k), "int32")
    held = chunks.single()
    # Likenesses and what passes of them, in the same memory for every panel: taking fresh memory costs more than filling it.
    most = max(high - low for low, high in ((pieces.starts[a], pieces.ends[b - 1]) for a, b in pieces.panels))
    room, marks = (np.empty(min(STRIP_ROWS, len(queries)) * most, kind) for kind in ("float32", bool))
    for start in range(0, len(queries), STRIP_ROWS):
        strip = np.arange(start, min(len(queries), start + STRIP_ROWS))
        unit = queries.unit(strip)
        single = unit.astype("float32")
        top, own = distances[start:start + STRIP_ROWS], ranks[start:start + STRIP_ROWS]  # views
        leading = np.full((len(strip), k), -np.inf, "float32")  # the k greatest likenesses so far
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # places of queries and chunks, and their likenesses
        least = pieces.nearest(unit)
        near = np.minimum.reduceat(least, [a for a, _ in pieces.panels], axis=1).mean(axis=0)
        gone = rejected.of(queries.place[strip]) if rejected is not None else None
        for p in np.argsort(near, kind="stable"):
            a, b = pieces.panels[p]
            limit = leading.min(axis=1) - 2 * slack
            needed = (least[:, a:b] <= np.minimum(top[:, -1], 1.0 - limit)[:, None]).any(axis=0)
            if not needed.any():
                continue
            low, high = pieces.starts[a:b][needed], pieces.ends[a:b][needed]
            columns = slice(low[0], high[-1]) if needed.all() else _ranges(low, high)[0]
            width = high[-1] - low[0] if needed.all() else len(columns)
            likeness = np.matmul(single, held[columns].T, out=room[:len(strip) * width].reshape(len(strip), width))
            if gone is not None and len(gone[0]):
                known = jd[columns]
                order = np.argsort(known, kind="stable")
                at, pair = _ranges(np.searchsorted(known, gone[1], sorter=order), np.searchsorted(known, gone[1], "right", sorter=order))
                likeness[gone[0][pair], order[at]] = -np.inf
            short = np.flatnonzero(~np.isfinite(limit))
            if len(short):
                limit[short] = -2.0
                if width > k:
                    part = np.partition(likeness if len(short) == len(strip) else likeness[short], width - k, axis=1)
                    limit[short] = np.maximum(limit[short], part[:, width - k] - 2 * slack)
            passes = np.greater_equal(likeness, limit[:, None], out=marks[:likeness.size].reshape(likeness.shape))
            r, c = np.divmod(np.flatnonzero(passes), width)
            if not len(r):
                continue
            value = likeness[r, c]
            c = c + columns.start if isinstance(columns, slice) else columns[c]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            widest = place.max() + 1
            beside = np.full((len(strip), k + widest), -np.inf, "float32")
            beside[:, :k] = leading
            beside[r, k + place] = value
            leading = np.partition(beside, widest, axis=1)[:, widest:]
            waiting.append(_passing(r, c, value, leading.min(axis=1) - 2 * slack))
            if sum(len(w[0]) for w in waiting) > WAITING_PAIRS:
                _settle(waiting, leading.min(axis=1) - 2 * slack, queries, chunks, start, rank, top, own)
        _settle(waiting, leading.min(axis=1) - 2 * slack, queries, chunks, start, rank, top, own)
    for start in range(0, len(ranks), PANEL_ROWS):
        ranks[start:start + PANEL_ROWS] = where[ranks[start:start + PANEL_ROWS]]
    return distances, ranks


def _search(k: int, dim: int, block_rows: int, pivots):
    """Rows of hits of the queries of a shard among the chunks of a slab."""

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        rejected = None
        if "forbidden" in asked.column_names:
            rejected = _Rejected(asked)
            asked = asked.filter(pc.is_null(asked["forbidden"]))
        keys = asked.select(QUERY_KEYS)
        queries, chunks = _Vectors(asked["embedding"], dim), _Vectors(held["embedding"], dim)
        if not len(queries) or not len(chunks):
            return _hit_table(keys.slice(0, 0), held.slice(0, 0), np.empty((0, 1)), np.empty((0, 1), "int32"))
        asked, held = keys, held.drop_columns(["embedding"])
        # A chunk's rank is the place of its id. Numbers are sorted, and vectors move once, into the order of cells.
        by_id = held.take(pa.array(chunks.place)).append_column("at", pa.array(np.arange(len(chunks)))).sort_by("chunk_id")
        by_id, at = by_id.drop_columns(["at"]), by_id["at"].to_numpy()
        cell = by_id["cell"].to_numpy()
        order = np.argsort(cell, kind="stable")
        if len(pivots.value) > 1:  # neighbours make strips that need the same cells
            around = pivots.value.T.astype("float32")
            home = [
                (queries.unit(slice(start, start + STRIP_ROWS)).astype("float32") @ around).argmax(axis=1) for start in range(0, len(queries), STRIP_ROWS)]
            queries.ordered(np.argsort(np.concatenate(home), kind="stable"))
        chunks.ordered(at[order])
        jd = by_id["jd_id"].fill_null(np.iinfo("int64").min).to_numpy()[order]
        distances, at = _best(queries, chunks, cell[order], order, jd, min(k, len(chunks)), block_rows, rejected)
        place = pa.array(queries.place)
        del queries, chunks, rejected  # vectors aren't needed beside the hits
        return _hit_table(keys.take(place), by_id.select(["chunk_id", "jd_id"]).take(pa.array(order)), distances, at)

    return search


def _hit_table(keys: pa.Table, chunks: pa.Table, distances: np.ndarray, at: np.ndarray) -> pa.Table:
    found = np.isfinite(distances)
    ends = np.concatenate([[0], np.cumsum(found.sum(axis=1))]).astype("int32")
    rows, at = chunks.combine_chunks(), pa.array(at[found])  # of a slab; its columns are in one piece, and so are the hits
    fields = {"distance": pa.array(distances[found], pa.float64())} | {
        c: rows[c].chunk(0).take(at) if rows[c].num_chunks else pa.array([], pa.int64()) for c in ("chunk_id", "jd_id")}
    hits = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
    return keys.append_column("hits", hits)


def _pick_pivots(chunks: DataFrame, n_cells: int, dim: int) -> np.ndarray:
    """One chunk vector per hash group: n_cells rows, whatever the size of the table."""
    picked = (
        chunks.groupBy(F.pmod(F.xxhash64("chunk_id"), F.lit(n_cells)).alias("g"))
        .agg(F.min_by("embedding", F.xxhash64("chunk_id", F.lit(1))).alias("embedding"))
        .orderBy("g").toPandas()
    )
    return _matrix(picked["embedding"], dim)[0]


def _locate(rows: DataFrame, pivots, dim: int) -> DataFrame:
    """Add the nearest pivot (``cell``); rows without a usable vector get none."""

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        unit, kept = _matrix(vectors, dim)
        out = pd.Series(pd.array([None] * len(vectors), dtype="Int32"))
        out.iloc[kept] = 0  # no pivot is usable where the vectors that were picked are not
        for start in range(0, len(kept) if len(pivots.value) else 0, STRIP_ROWS):
            part = slice(start, start + STRIP_ROWS)
            out.iloc[kept[part]] = (unit[part] @ pivots.value.T).argmax(axis=1).astype("int32")
        return out

    return rows.withColumn("cell", nearest("embedding")).where("cell IS NOT NULL")


def _block_rows(rows: int, dim: int) -> int:
    """Rows of a block whose vectors, as doubles, stay within BLOCK_BYTES."""
    return max(1, min(rows, BLOCK_BYTES // (8 * dim)))


def grid(n_queries: int, n_chunks: int, k: int, dim: int, width: int) -> tuple[int, int]:
    """Numbers of shards and slabs: both bounded in bytes, tasks enough for ``width`` cores, and as few bytes as possible to move."""
    chunk, query = 4 * dim + 24, 4 * dim + 24 * k
    shards, slabs = max(1, -(-n_queries * query // SHARD_BYTES)), max(1, -(-n_chunks * 4 * dim // SLAB_BYTES))
    tasks = max(1, min(2 * width, n_queries * n_chunks // TASK_PAIRS))
    forms = [(p, max(slabs, -(-tasks // p))) for p in range(shards, max(shards, tasks) + 1)]
    return min(forms, key=lambda f: n_chunks * f[0] * chunk + n_queries * f[1] * (chunk + query))


def _task_number(spark: SparkSession, number: Column, parts: int) -> Column:
    """A number for each of the tasks 0 to parts - 1 that Spark deals to a partition of its own; by the hash of ``number`` some get several, others none."""
    if parts > LISTED_TASKS:
        return number
    tried = F.col("id").cast("int")
    rows = spark.range(0, parts * 24, 1, 1).select(tried.alias("n"), F.pmod(F.hash(tried), F.lit(parts)).alias("at")).collect()
    own = {r["at"]: r["n"] for r in reversed(rows)}
    return F.get(F.array(*[F.lit(own[p]) for p in range(parts)]), number) if len(own) == parts else number


def _nearest(
    queries: DataFrame, chunks: DataFrame, n_chunks: int, block_rows: int, k: int, dim: int, rejected: DataFrame | None = None,
) -> DataFrame:
    """One row per query with its k nearest chunks as ``hits``, partitioned by target."""
    spark = queries.sparkSession
    n_cells = max(1, min(PIVOT_BYTES // (8 * dim), n_chunks // block_rows))
    pivots = spark.sparkContext.broadcast(_pick_pivots(chunks, n_cells, dim))
    placed = materialize(_locate(chunks, pivots, dim), "chunk-cells")
    shards, slabs = grid(queries.select("query_id").count(), n_chunks, k, dim, spark.sparkContext.defaultParallelism)
    loads = placed.groupBy("cell").count().orderBy("cell").collect()
    total, before, plan = sum(r["count"] for r in loads), 0, []
    for r in loads:
        plan.append((r["cell"], before, r["count"]))
        before += r["count"]
    plan = spark.createDataFrame(plan, "cell int, before long, n long")
    # Slabs take equal shares of the chunks in the order of cells; within a cell a hash of the id deals.
    place = F.col("before") + F.pmod(F.xxhash64("chunk_id"), F.col("n"))
    shard = F.pmod(F.xxhash64(*TARGET_KEYS), F.lit(shards)).cast("int")
    every_slab, every_shard = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (slabs, shards))
    left = queries.withColumns({"shard": shard, "slab": every_slab})
    if rejected is not None:
        pairs = rejected.where(F.col("jd_id").isNotNull()).select(*TARGET_KEYS, F.col("jd_id").cast("long").alias("forbidden")).distinct()
        asked = pairs.join(queries.select(*TARGET_KEYS).distinct(), TARGET_KEYS, "left_semi")
        left = left.unionByName(asked.withColumns({"shard": shard, "slab": every_slab}), allowMissingColumns=True)
    right = (
        placed.join(plan, "cell").withColumn("slab", F.floor(place * slabs / max(1, total)).cast("int")).drop("before", "n")
        .withColumn("shard", every_shard)
    )
    parts = min(shards * slabs, MAX_PARTITIONS)
    # From here on ``shard`` is the number of a task: of a shard and the slab it meets.
    task = _task_number(spark, F.col("shard") * slabs + F.col("slab"), parts)
    left, right = (t.withColumn("shard", task).drop("slab").repartition(parts, "shard") for t in (left, right))
    kinds = dict(queries.dtypes)
    fields = ", ".join(f"{c} {kinds[c]}" for c in QUERY_KEYS) + f", hits array<{HIT}>"
    lists = left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(_search(k, dim, block_rows, pivots), fields)
    merged = lists.repartition(*TARGET_KEYS).groupBy(*QUERY_KEYS).agg(F.flatten(F.collect_list("hits")).alias("hits"))
    return merged.withColumn("hits", F.slice(F.sort_array("hits"), 1, k))


def nearest_chunks(
    queries: DataFrame,
    chunks: DataFrame,
    *,
    top_k: int,
    dim: int,
    chunk_types: Sequence[str] | None = None,
    block_rows: int = BLOCK_ROWS,
    rejected: DataFrame | None = None,
    as_lists: bool = False,
) -> DataFrame:
    """``resume_id, target_id, query_id, chunk_id, jd_id, distance, chunk_rank, similarity``; with ``as_lists`` one row per query, its hits
    by rank as ``hits`` (distance, chunk_id, jd_id).

    Queries carry ``embedding``. ``rejected`` (resume_id, target_id, jd_id) names JDs that a target must not meet again. Query and chunk vectors that are
    NULL, of another dimension, not finite or of length zero take no part; ``check_vectors`` lists them.
    """
    if top_k <= 0:
        raise ValueError(f"top_k must be greater than 0, got {top_k}")
    usable = embeddable(chunks, chunk_types).select("chunk_id", "jd_id", "embedding")
    asked = queries.select(*QUERY_KEYS, "embedding")
    n_chunks = usable.select("chunk_id").count()
    lists = _nearest(asked, usable, n_chunks, _block_rows(block_rows, dim), top_k, dim, rejected)
    if as_lists:
        return lists
    hits = explode_rows(lists, QUERY_KEYS, "hits", "h", "rank")
    return hits.select(
        *QUERY_KEYS, "h.chunk_id", "h.jd_id", "h.distance", (F.col("rank") + 1).alias("chunk_rank"),
        (F.lit(1.0) - F.col("h.distance")).alias("similarity"))
