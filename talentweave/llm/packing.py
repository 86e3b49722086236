"""Concatenate and cut: documents become one long row of token ids, cut at every ``width`` ids.

First pass: each task tokenises its rows, numbers the ids it has seen and writes rows with their ids to the shared
folder; totals per task are summed over the tasks before it, which gives every document its global offset. Second
pass: windows of fixed width are cut out of the global row, with a record for each piece of a document in a
window. All windows but the last are full, so there is next to no padding. Nothing is shuffled except the totals, of
which there is one row per task. A written pass is fixed, so a lost executor can't change offsets.

Documents of one task follow each other as they are read, and tasks by number. With ``as_written`` the documents of a
stored table keep the order in which it was written: files by name, parts of a file by their start, rows as they lie. Tasks may
read these parts in any order, so totals are then summed per part.

NULL texts count as empty; a text without ids is its end id alone. Rows that repeat are separate documents. An
empty table has no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentweave.llm.words import gathered, numbered, slices, subwords
from talentweave.plans.storage import materialize

WIDTH = 4096
END_ID = 2
PIECE_ROWS = 8192

TOKEN_FIELDS = "doc_id bigint, file string, block bigint, local bigint, n bigint, ids binary"
PIECE_FIELDS = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, ids binary"
)


def tokenised(
    docs: DataFrame, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", as_written: bool = False,
) -> DataFrame:
    """First pass: ids of each document (little-endian unsigned 32-bit), its block and the ids before it in the task.

    A block is a task, or with ``as_written`` a part of a file that one task reads in a row.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            names, done = batch.column("doc_id"), 0
            files = batch.column("file") if as_written else pa.array([""] * len(names))
            blocks = batch.column("block") if as_written else pa.array(np.full(len(names), task, "int64"))
            for texts in slices(batch.column("text")):
                ends, word, different = numbered(texts, lower=False)
                ids, after = gathered(*subwords(different, vocabulary), word)
                cuts = after[ends]
                rows = [ids[a:b].tobytes() + end_id.to_bytes(4, "little") for a, b in zip(cuts, cuts[1:])]
                sizes = np.diff(cuts) + 1
                yield pa.RecordBatch.from_pydict({
                    "doc_id": names.slice(done, len(texts)), "file": files.slice(done, len(texts)), "block": blocks.slice(done, len(texts)),
                    "local": pa.array(seen + np.cumsum(sizes) - sizes), "n": pa.array(sizes), "ids": pa.array(rows, pa.binary()),
                })
                done, seen = done + len(texts), seen + int(sizes.sum())

    part = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block")] if as_written else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *part)
    return rows.mapInArrow(encode, TOKEN_FIELDS)


def _cut(width: int, keep_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, n = batch.column("doc_id").to_pylist(), batch.column("n").to_pylist()
            at, ids, out = batch.column("at").to_pylist(), batch.column("ids"), []
            for i in range(len(doc)):
                data, start = memoryview(ids[i].as_buffer()), 0
                while start < n[i]:
                    window, offset = divmod(at[i] + start, width)
                    length = min(n[i] - start, width - offset)
                    piece = data[4 * start:4 * (start + length)]
                    out.append((doc[i], start, length, crc32(piece), n[i], window, offset, bytes(piece) if keep_ids else None))
                    start += length
                if len(out) >= PIECE_ROWS:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return cut


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in PIECE_FIELDS.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.binary()]
    return pa.RecordBatch.from_pydict({c: pa.array(v, k) for c, v, k in zip(names, zip(*rows), kinds)})


def packed(
    docs: DataFrame, vocabulary: str, width: int = WIDTH, end_id: int = END_ID, keep_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text", as_written: bool = False,
) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, begins, ends`` and, on request, ``ids``.

    ``begins`` and ``ends`` tell whether the document begins and ends in the piece; the others are boundary records.
    """
    tokens = materialize(tokenised(docs, vocabulary, end_id, id_col, text_col, as_written), "token-ids")
    totals = tokens.groupBy("file", "block").agg(F.sum("n").alias("total"), F.min("local").alias("from"))
    before = Window.orderBy(F.length("file"), "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        F.col("file").alias("of_file"), F.col("block").alias("of"), (F.coalesce(F.sum("total").over(before), F.lit(0)) - F.col("from")).alias("base"))
    # One row per task, or part of a file, of the first pass, so this side stays small.
    placed = tokens.join(F.broadcast(base), (F.col("file") == F.col("of_file")) & (F.col("block") == F.col("of"))).select(
        "doc_id", "n", (F.col("base") + F.col("local")).alias("at"), "ids")
    pieces = placed.mapInArrow(_cut(width, keep_ids), PIECE_FIELDS)
    marked = pieces.withColumns({"begins": F.col("start") == 0, "ends": F.col("start") + F.col("length") == F.col("doc_tokens")})
    return marked if keep_ids else marked.drop("ids")
