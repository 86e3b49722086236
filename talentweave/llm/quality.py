"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document is a logistic function of its weights and of all pairwise interactions, each the
product of two short vectors. With x the feature values, v the vectors and w the weights it takes linear time:

    w0 + sum(w x) + 1/2 sum over dimensions of (sum(v x))^2 - sum(v^2 x^2)

Features: hashed words (A-Z lower-cased), their counts scaled to length one; statistics of the text's structure, each
as one of a few bins; and the bin of the length noted in the table's metadata, where there is one. Source, language,
ids and labels are never features.

The model is fitted on at most ``max_rows`` labelled documents, chosen by a hash of their id, that ``may_train`` admits;
their features, not their texts, come to the driver. Everything else covers all rows. Several labels of one id are averaged
and NULL labels ignored. Without labels all scores are 0.5. NULL texts count as empty and get a score like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentweave.llm.columns import boxed, unboxed

WORD_SLOTS = 1 << 15
MAX_ROWS = 12_000
RANK = 4
STEPS = 2500  # batches, at least; one pass over the rows at least
BATCH = 64
RATE = 0.1
DECAY = 2e-4
STATISTIC_VALUE = 0.6  # of a bin; the words of a document together have length one
THRESHOLD = 0.3
BINS = 16  # per statistic; the last one is for "unknown"

#: Upper edges of the bins of each statistic.
EDGES = {
    "n_words": [1, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10_000],
    "word_length": [1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 15],
    "different": [0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0],
    "top_word": [0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8],
    "same_as_last": [0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9],
    "upper": [0.001, 0.01, 0.02, 0.03, 0.04, 0.06, 0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 0.9],
    "digit": [0.0001, 0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5],
    "symbol": [0.0001, 0.001, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5],
    "mark": [0.0001, 0.001, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5],
    "lines": [0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5],
    "same_lines": [0.001, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9],
    "noted_length": [1, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10_000, 20_000, 50_000],
}
SLOTS = WORD_SLOTS + len(EDGES) * BINS
#: What the per-character statistics count.
CLASSES = {"upper": range(65, 91), "digit": range(48, 58), "symbol": b"#*$%&|<>{}[]=_~^\\/+@", "mark": b".,;:!?"}
TABLES = {name: bytes(i for i in range(256) if i in set(members)) for name, members in CLASSES.items()}


def _statistics(text: bytes, words: list[bytes], noted: float | None) -> dict[str, float | None]:
    n = len(words)
    size = max(1, len(text))
    counted = {name: (len(text) - len(text.translate(None, members))) / size for name, members in TABLES.items()}
    lines = [line for line in text.split(b"\n") if line.strip()]
    if not n:
        return counted | {"n_words": 0, "noted_length": noted}
    numbers = np.unique(np.array([crc32(w) for w in words], dtype="uint32"), return_inverse=True)[1]
    return counted | {
        "n_words": n, "word_length": sum(map(len, words)) / n, "different": (int(numbers.max()) + 1) / n,
        "top_word": int(np.bincount(numbers).max()) / n, "same_as_last": float((numbers[1:] == numbers[:-1]).sum()) / n,
        "lines": len(lines) / n, "same_lines": 1 - len(set(lines)) / max(1, len(lines)), "noted_length": noted,
    }


def features(text: bytes, noted: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the features of a document."""
    words = text.lower().split()
    slots = np.fromiter((crc32(w) for w in words), dtype="uint32", count=len(words)) % WORD_SLOTS
    index, counts = np.unique(slots, return_counts=True)
    counts = np.sqrt(counts)  # a word said often says little more
    norm = np.sqrt((counts * counts).sum()) or 1.0
    found = _statistics(text, words, noted)
    bins = [
        WORD_SLOTS + i * BINS + (BINS - 1 if found.get(name) is None else int(np.searchsorted(edges, found[name])))
        for i, (name, edges) in enumerate(EDGES.items())
    ]
    return (
        np.concatenate([index.astype("int64"), np.array(bins, dtype="int64")]),
        np.concatenate([counts / norm, np.full(len(bins), STATISTIC_VALUE)]).astype("float32"),
    )


class FactorisationMachine:
    """Weights of the machine; fitting visits documents in a fixed pseudo-random order."""

    def __init__(self, slots: int = SLOTS, rank: int = RANK, seed: int = 7):
        self.bias, self.weight = 0.0, np.zeros(slots, dtype="float32")
        self.vectors = np.random.default_rng(seed).normal(0, 0.05, (slots, rank)).astype("float32")

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        scaled = self.vectors[index] * value[:, None]
        summed = scaled.sum(axis=0)
        return float(self.bias + self.weight[index] @ value + 0.5 * (summed @ summed - (scaled * scaled).sum()))

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(index, value), -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> None:
        """Adagrad on the logistic loss, in batches of documents; steps touch just the features of a batch."""
        if not len(rows):
            return
        prior = np.clip(labels.mean(), 0.01, 0.99)
        self.bias = float(np.log(prior / (1 - prior)))
        seen_w, seen_v, seen_b = np.full(len(self.weight), 1e-2, "float32"), np.full(self.vectors.shape, 1e-2, "float32"), 1e-2
        rng = np.random.default_rng(seed)
        for _ in range(max(1, -(-steps * BATCH // len(rows)))):
            order = rng.permutation(len(rows))
            for start in range(0, len(rows), BATCH):
                batch = order[start:start + BATCH]
                index = np.concatenate([rows[i][0] for i in batch])
                value = np.concatenate([rows[i][1] for i in batch])[:, None]
                cuts = np.cumsum([0, *[len(rows[i][0]) for i in batch]])
                scaled = self.vectors[index] * value
                summed = np.add.reduceat(scaled, cuts[:-1], axis=0)
                raw = (
                    self.bias + np.add.reduceat(self.weight[index] * value[:, 0], cuts[:-1])
                    + 0.5 * ((summed * summed).sum(axis=1) - np.add.reduceat((scaled * scaled).sum(axis=1), cuts[:-1]))
                )
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[batch]).astype("float32")
                each = np.repeat(error, np.diff(cuts))[:, None]
                slot, owner = np.unique(index, return_inverse=True)
                by_slot = np.argsort(owner, kind="stable")
                firsts = np.concatenate([[0], np.flatnonzero(np.diff(owner[by_slot])) + 1])
                grad_v = each * value * (np.repeat(summed, np.diff(cuts), axis=0) - scaled)
                grad_v = np.add.reduceat(grad_v[by_slot], firsts, axis=0) / len(batch) + DECAY * self.vectors[slot]
                grad_w = np.add.reduceat((each * value)[by_slot, 0], firsts) / len(batch) + DECAY * self.weight[slot]
                seen_w[slot] += grad_w * grad_w
                seen_v[slot] += grad_v * grad_v
                self.weight[slot] -= RATE * grad_w / np.sqrt(seen_w[slot])
                self.vectors[slot] -= RATE * grad_v / np.sqrt(seen_v[slot])
                seen_b += float(error.mean()) ** 2
                self.bias -= RATE * float(error.mean()) / seen_b**0.5


def _noted(docs: DataFrame, metadata: str | None) -> Column:
    return F.col(f"`{metadata}`").cast("double") if metadata in docs.columns else F.lit(None).cast("double")


def fitted(
    docs: DataFrame, labels: DataFrame, may_train: Column, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", metadata: str | None = "n_chars",
) -> FactorisationMachine:
    """Fit on at most ``max_rows`` labelled documents. ``may_train`` is a condition on the labels' id.

    Of rows that repeat an id, the one with the smallest checksum of its text counts, so no more than ``max_rows`` rows are collected.
    """
    marked = (
        labels.where(may_train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.avg(label_col).alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    )
    chosen = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), _noted(docs, metadata).alias("_noted"))
    rows = chosen.join(F.broadcast(marked), "_id")  # at most max_rows ids

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, float]] = {}  # of each id, at most max_rows of them
        for batch in batches:
            out = []
            columns = (batch.column("_id").cast(pa.int64()), batch.column("_text").cast(pa.binary()), batch.column("_noted"), batch.column("_label"))
            for own, text, noted, label in zip(*columns):
                own, data, n = own.as_py(), text.as_py(), noted.as_py()
                key = crc32(data), -1.0 if n is None else n
                if own not in best or key < best[own]:
                    best[own] = key
                    slots, amounts = features(data, n)
                    out.append((own, *key, float(label.as_py()), slots.astype("<i4").tobytes(), amounts.astype("<f4").tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
            names = ["id", "digest", "noted", "label", "slots", "amounts"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    made = rows.mapInArrow(sparse, "id bigint, digest bigint, noted double, label double, slots binary, amounts binary")
    row = F.min(F.struct("digest", "noted", "label", "slots", "amounts")).alias("row")
    found = sorted(made.groupBy("id").agg(row).select("id", "row.*").collect(), key=lambda r: r.id)
    machine = FactorisationMachine()
    machine.fit(
        [(np.frombuffer(r.slots, "<i4").astype("int64"), np.frombuffer(r.amounts, "<f4")) for r in found],
        np.array([r.label for r in found], dtype="float32"),
    )
    if not found:
        machine.vectors[:] = 0  # every score 0.5
    return machine


def scored(docs: DataFrame, machine: FactorisationMachine, text_col: str = "text", metadata: str | None = "n_chars") -> DataFrame:
    """``docs`` with ``_score``: the probability of label 1, to nine digits. A column of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(machine)  # fixed size, given by the number of slots

    @F.arrow_udf("double")
    def score(texts: pa.Array, noted: pa.Array) -> pa.Array:
        model = held.value
        rows = zip(pc.fill_null(texts, "").cast(pa.binary()), noted.to_pylist())
        return pa.array([round(model.score(*features(t.as_py(), n)), 9) for t, n in rows], pa.float64())

    return docs.withColumn("_score", score(F.col(text_col), _noted(docs, metadata)))


def accepted(
    docs: DataFrame, machine: FactorisationMachine, threshold: float = THRESHOLD, text_col: str = "text", metadata: str | None = "n_chars",
) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with the columns of ``docs`` whatever their names."""
    known = [metadata] if metadata in docs.columns else []
    rows, (text, *noted) = boxed(docs, text_col, *known)
    return unboxed(scored(rows, machine, text, *noted or [None]).where(F.col("_score") >= threshold), docs)
