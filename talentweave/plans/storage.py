"""Where intermediate tables live: the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only for local sessions that name none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="talentweave-"))
    return spark.sparkContext.getCheckpointDir()


_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def noted_tables(paths: list[str]) -> Iterator[None]:
    """Add the paths of all tables that are materialised meanwhile to ``paths``, so that they can be dropped later."""
    token = _noted.set(paths)
    try:
        yield
    finally:
        _noted.reset(token)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if it doesn't exist."""
    files, place = _file_system(spark, path)
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete materialised tables that no pending DataFrame reads any more, and forget their paths."""
    while paths:
        files, place = _file_system(spark, paths.pop())
        files.delete(place, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back: later uses survive lost executors and see its real size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (noted := _noted.get()) is not None:
        noted.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
