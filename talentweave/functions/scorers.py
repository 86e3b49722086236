"""Pair scorers and query embedders: bundled defaults and wrappers for user models."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentweave.config import TITLE
from talentweave.functions import text as X

SCORE_ERROR = "score_error"  # column in which a scorer says why a pair has no score; scorers that can't fail have none


class JaccardScorer:
    """Share of common distinct tokens (lower case, split on single spaces); 0 when both texts are empty.

    ``prepare`` turns a text into its token set once, before pairs are formed. Where a text has to move first, ``shorten`` makes a
    text of its tokens, and ``expand`` makes the token set of that, with nothing but a split: ``expand(shorten(c))`` is ``prepare(c)``.
    """

    model_name = "token-jaccard"

    def prepare(self, c: Column) -> Column:
        return F.array_remove(F.array_distinct(F.split(F.lower(X.collapse_ws(c)), " ")), "")

    def shorten(self, c: Column) -> Column:
        return F.array_join(self.prepare(c), " ")

    def expand(self, c: Column) -> Column:
        return F.array_remove(F.split(c, " "), "")

    def score(self, rows: DataFrame, left: str, right: str, out: str) -> DataFrame:
        common = F.size(F.array_intersect(left, right))
        return rows.withColumn("_common", common).withColumn(
            out, F.coalesce(F.try_divide(F.col("_common"), F.size(left) + F.size(right) - F.col("_common")), F.lit(0.0))
        ).drop("_common")


@functools.cache
def _held(pickled: bytes):
    return cloudpickle.loads(pickled)()


def model_of(factory: Callable) -> Callable:
    """A function that gives the model of ``factory``, made once per Python worker process however many tasks it runs."""
    pickled = cloudpickle.dumps(factory)
    return lambda: _held(pickled)


class ModelScorer:
    """A user model ``factory() -> score_pairs(list of (text, text)) -> list of float in [0, 1]``.

    The model is made once per Python worker process. Equal pairs are scored once: the table of distinct pairs
    is keyed by a hash of both texts, so the texts move through one exchange and come back as a score.
    A pair without a usable score has NULL and the reason in ``score_error``; where a batch fails its pairs are scored one by one, so that
    the others keep theirs. A factory that fails fails the job, since no pair could be scored.
    """

    def __init__(self, factory: Callable[[], Callable[[list], Sequence[float]]], model_name: str, batch_size: int = 8):
        self.factory, self.model_name, self.batch_size = factory, model_name, batch_size

    def prepare(self, c: Column) -> Column:
        return X.collapse_ws(c)

    def shorten(self, c: Column) -> Column:
        return self.prepare(c)

    def expand(self, c: Column) -> Column:
        return c

    def score(self, rows: DataFrame, left: str, right: str, out: str) -> DataFrame:
        held, size = model_of(self.factory), self.batch_size

        @F.pandas_udf("score double, error string")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            model = held()
            for a, b in batches:
                pairs = list(zip(a, b, strict=True))
                found = [r for start in range(0, len(pairs), size) for r in _scored(model, pairs[start:start + size])]
                yield pd.DataFrame(found, columns=["score", "error"]).astype({"score": "float64", "error": "object"})

        keyed = rows.withColumn("_pair", F.sha2(F.concat_ws("\x00", F.col(left), F.col(right)), 256))
        distinct = keyed.select("_pair", left, right).dropDuplicates(["_pair"])
        scored = distinct.select("_pair", run(left, right).alias("_found")).select(
            "_pair", F.when(F.col("_found.error").isNull(), F.col("_found.score")).alias(out), F.col("_found.error").alias(SCORE_ERROR))
        return keyed.drop(SCORE_ERROR).join(scored, "_pair").drop("_pair")


def _scored(model: Callable[[list], Sequence[float]], pairs: list) -> list[tuple[float | None, str | None]]:
    """Score and error of each pair: one call for all, and one for each of them if that fails."""
    try:
        got = [float(s) for s in model(pairs)]
    except Exception as exc:  # a model may raise anything
        if len(pairs) > 1:
            return [r for pair in pairs for r in _scored(model, [pair])]
        return [(None, type(exc).__name__)]
    if len(got) != len(pairs):
        return [r for pair in pairs for r in _scored(model, [pair])] if len(pairs) > 1 else [(None, "score_count")]
    return [(s, None) if 0.0 <= s <= 1.0 else (None, "score_out_of_range") for s in got]


def hashed_ngrams(texts: Sequence[str], dim: int, n: int = 3) -> np.ndarray:
    """Signed hashed character n-grams, unit length; the bundled stand-in for an embedding model.

    All n-grams of a batch are hashed at once, as numbers of their characters, and counted in one pass. A text
    shorter than an n-gram counts as one.
    """
    padded = [f" {value} ".ljust(n) for value in texts]
    lengths = np.array([len(p) for p in padded], dtype="int64")
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), dtype="<u4").astype("uint64")
    grams = lengths - n + 1
    owner = np.repeat(np.arange(len(padded)), grams)
    first = np.arange(len(owner)) + np.repeat((np.cumsum(lengths) - lengths) - (np.cumsum(grams) - grams), grams)
    code = np.zeros(len(owner), dtype="uint64")
    for i in range(n):
        code = (code ^ codes[first + i]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    sign = np.where(code >> np.uint64(63) == 1, 1.0, -1.0)
    slot = owner * dim + (code % np.uint64(dim)).astype("int64")
    out = np.bincount(slot, weights=sign, minlength=len(padded) * dim).reshape(len(padded), dim).astype("float32")
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms)


class NgramEmbedder:
    def __init__(self, dim: int = 1024):
        self.dim, self.model_name = dim, "hashed-char-ngrams"

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        return hashed_ngrams(texts, self.dim)


def embed_texts(rows: DataFrame, factory: Callable[[], Callable[[Sequence[str]], np.ndarray]], column: str = "text",
                batch_size: int = 8, distinct: bool = True) -> DataFrame:
    """Add ``embedding``, a unit vector per text.

    ``factory`` makes the model, once per Python worker process. With ``distinct`` each different text
    is computed once and joined back; without it rows are mapped in place and nothing is shuffled,
    which is cheaper where texts seldom repeat.
    """
    held = model_of(factory)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = held()
        for texts in batches:
            values = texts.tolist()
            parts = [np.asarray(model(values[i:i + batch_size])) for i in range(0, len(values), batch_size)]
            matrix = np.concatenate(parts) if parts else np.empty((0, 1))
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            yield pd.Series(list((matrix / np.where(norms == 0, 1, norms)).astype("float32")))

    if not distinct:
        return rows.withColumn("embedding", run(column))
    keyed = rows.withColumn("_text_key", F.sha2(F.col(column), 256))
    once = keyed.select("_text_key", column).dropDuplicates(["_text_key"])
    return keyed.join(once.select("_text_key", run(column).alias("embedding")), "_text_key").drop("_text_key")


def embed_units(units: DataFrame, factory: Callable[[], Callable[[Sequence[str]], np.ndarray]], batch_size: int = 8) -> DataFrame:
    """Embed query units by one model step: popular titles once for all who ask for them, evidence texts by row.

    Titles are keyed by their text, other units by what identifies them, so one table of texts holds each title
    once; vectors come back by key.
    """
    is_title = F.col("query_type") == TITLE
    key = F.when(is_title, F.sha2("text", 256)).otherwise(F.concat_ws(" ", F.col("resume_id").cast("string"), "target_id", "query_id"))
    keyed = units.withColumn("_key", key)
    once = keyed.groupBy("_key").agg(F.any_value("text").alias("text"))
    vectors = embed_texts(once, factory, batch_size=batch_size, distinct=False).drop("text")
    return keyed.join(vectors, "_key").drop("_key")
