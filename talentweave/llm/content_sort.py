"""Exact deduplication by sorting contents.

Sampled splitters deal the rows out by range, an external sort inside each partition places equal texts
next to each other, and every row is compared in full with its neighbour. The sort key is a bounded
prefix, a hash, the whole text and the id in falling order; splitters hold only prefix, hash and id, so
sampling never sends whole texts to the driver, and a text with very many copies spreads over
as many partitions as its rows need. Runs of equal texts that reach the edge of a partition are
joined with runs of other partitions by SHA-256; there are at most two of them per partition.

NULL texts count as empty. NULL ids come last; a group without any id has no ``keep_id``. Of rows that tie
in text and id one is kept. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.plans.storage import materialize

PREFIX_CHARS = 16  # of the text, in the splitters
BATCH_ROWS, BATCH_BYTES = 4096, 1 << 24  # sent back at a time

RUN_FIELDS = "doc_id bigint, text_sha256 string, part int, edge boolean, first boolean, n bigint, top bigint"
KINDS = {
    "doc_id": pa.int64(), "text_sha256": pa.string(), "part": pa.int32(), "edge": pa.bool_(), "first": pa.bool_(),
    "n": pa.int64(), "top": pa.int64(),
}


def _sorted(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    keyed = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)],
    ).withColumns({"_prefix": F.substring("_text", 1, PREFIX_CHARS), "_hash": F.xxhash64("_text")})
    falling = F.col("_id").desc_nulls_last()
    dealt = keyed.repartitionByRange("_prefix", "_hash", falling)
    return dealt.sortWithinPartitions("_prefix", "_hash", "_text", falling).drop("_prefix", "_hash")


def _walk(whole_groups: bool):
    """A pass over one sorted partition. With ``whole_groups`` every row comes back, once its run has ended;
    without, just the first row of each run, with the carried columns."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, text, digest, ids, runs, size = TaskContext.get().partitionId(), None, "", [], 0, 0
        held: pa.RecordBatch | None = None  # carried columns of the first row of the open run
        carried: list[pa.RecordBatch] = []
        out: dict[str, list] = {c: [] for c in KINDS}

        def close(last: bool) -> None:
            rows = len(ids) if whole_groups else 1
            for name, values in (
                ("doc_id", ids[:rows]), ("text_sha256", [digest] * rows), ("part", [part] * rows),
                ("edge", [last or runs == 1] * rows), ("first", [True] + [False] * (rows - 1)),
                ("n", [len(ids)] * rows), ("top", [ids[0]] * rows),
            ):
                out[name] += values
            if not whole_groups:
                carried.append(held)

        def flush() -> pa.RecordBatch:
            columns = {c: pa.array(values, KINDS[c]) for c, values in out.items()}
            if not whole_groups:
                for c, values in zip(held.schema.names, zip(*[b.columns for b in carried])):
                    columns[c] = pa.concat_arrays(values)
                carried.clear()
            for values in out.values():
                values.clear()
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            texts, own = batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("_id").to_pylist()
            rest = batch.drop_columns(["_id", "_text"])
            for i, value in enumerate(texts):
                if runs and value == text:
                    ids.append(own[i])
                    continue
                if runs:
                    close(False)
                    if len(out["n"]) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield flush()
                        size = 0
                text, digest, ids, runs = value, sha256(value).hexdigest(), [own[i]], runs + 1
                if not whole_groups:
                    held, size = rest.slice(i, 1), size + len(value)
        if runs:
            close(True)
            yield flush()

    return walk


def _resolved(runs: DataFrame) -> DataFrame:
    """Join the runs at partition edges: at most two per partition, so their summary is small."""
    edges = runs.where("edge AND first").groupBy(F.col("text_sha256").alias("_sha")).agg(
        F.sum("n").alias("_n"), F.max("top").alias("_top"), F.min("part").alias("_part"))
    joined = runs.join(F.broadcast(edges), (F.col("text_sha256") == F.col("_sha")) & F.col("edge"), "left")
    return joined.withColumns({
        "keep_id": F.when(F.col("_sha").isNull(), F.col("top")).otherwise(F.col("_top")),
        "group_size": F.coalesce("_n", "n"),
        "kept": F.col("first") & (F.col("_part").isNull() | (F.col("part") == F.col("_part"))),
    })


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``; the largest id of equal texts stays."""
    walked = _sorted(docs, id_col, text_col, []).mapInArrow(_walk(True), RUN_FIELDS)
    found = _resolved(materialize(walked, "content-runs"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``content_groups`` keeps, with all their columns."""
    names = docs.columns
    ordered = _sorted(docs, id_col, text_col, names)
    carried = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    runs = T.StructType.fromDDL(RUN_FIELDS)
    firsts = ordered.mapInArrow(_walk(False), T.StructType(runs.fields + carried.fields))
    found = _resolved(materialize(firsts, "content-firsts")).where("kept")
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
