"""Job descriptions, text chunks and the alias dictionary as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.operators.similarity import embeddable
from talentweave.schemas import JD_COLUMNS


def jd_scan(jd: DataFrame) -> DataFrame:
    """The thirteen JD columns by name, so that the scan reads nothing else."""
    return jd.select(*JD_COLUMNS)


def chunk_scan(chunks: DataFrame, chunk_types: list[str] | None = None) -> DataFrame:
    """Chunks that may be recalled; both conditions reach the file scan."""
    return embeddable(chunks, chunk_types)


def read_jdbc(
    spark: SparkSession, url: str, table: str, *, lower: int, upper: int, num_partitions: int, partition_column: str = "id",
    **options: str,
) -> DataFrame:
    """A database table, read in ``num_partitions`` ranges of an integer key that lies between ``lower`` and ``upper``.

    Bounds and number have no defaults, because a wrong guess reads the whole table through one task. ``min``
    and ``max`` of an indexed key are one cheap query.
    """
    if num_partitions < 1 or lower >= upper:
        raise ValueError("read_jdbc needs lower < upper and at least one partition")
    ranges = {"partitionColumn": partition_column, "lowerBound": lower, "upperBound": upper, "numPartitions": num_partitions}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **{k: str(v) for k, v in ranges.items()}, **options).load()


def standard_titles(jd: DataFrame) -> DataFrame:
    return jd.select("job_title").distinct()


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Alias dictionary kept by the user as CSV with the columns alias_title, standard_title.

    Repeated aliases are resolved where titles are looked up; ``exact.alias_conflicts`` lists those that contradict.
    """
    return spark.read.csv(path, header=True, schema="alias_title string, standard_title string")


def write_results(results: DataFrame, path: str, run_date: str) -> None:
    """One JSON document per résumé, filed under the date of the run.

    Writing a date again replaces what it has and leaves other dates alone; without rows nothing changes.
    """
    dated = results.withColumn("run_date", F.lit(run_date))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").json(path)
