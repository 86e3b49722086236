"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it and reads it again for the next one.
All stages but the last return the columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from talentweave.llm import content_sort, mixing, near_copies, packing, quality
from talentweave.llm.columns import id_remainder, table
from talentweave.llm.queries import vocabulary
from talentweave.plans.storage import drop_tables, materialize, noted_tables

#: Tokenizer files and a trained model have no form in SQL.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the factorisation machine, fitted on labelled documents, rejects."""
    machine = quality.fitted(docs, table(spark, sf_dir, "labels"), id_remainder("doc_id", 5) != 0)
    return quality.accepted(docs, machine)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return content_sort.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts linked by a Jaccard similarity of 0.8 or more of their five-word shingles."""
    return near_copies.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, in the order of the schedule; a document comes as often as its source is repeated."""
    return mixing.repeated_rows(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens in the order of a written mix, a row for each piece of a document in a sequence, with its ids."""
    return packing.packed(docs, vocabulary("word_bpe_49k.json"), keep_ids=True, as_written=_written(docs))


def _written(docs: DataFrame) -> bool:
    """Whether ``docs`` is just a written table."""
    return docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation"


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that a stage has written for itself, by the place of the stage.
_scratch: dict[int, list[str]] = {}


def _tidy(place: int, stage: Stage) -> Stage:
    """The stage; where it reads a written table, it first drops what the stages before it wrote for themselves.

    Their results are written by then, so nothing needs these tables any more. A lazy input may, and drops nothing.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _written(docs):
            for earlier in range(place):
                drop_tables(spark, _scratch.get(earlier, []))
        with noted_tables(_scratch.setdefault(place, [])):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    (name, _tidy(place, stage))
    for place, (name, stage) in enumerate([
        ("quality classifier", good_quality),
        ("exact dedup", without_copies),
        ("near dedup", without_near_copies),
        ("mixing", mixed_sources),
        ("packing", packed_sequences),
    ])
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
