"""Row-making helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def raise_on(df: DataFrame, reason: str, keys: list[str]) -> DataFrame:
    """Strict mode of a check: reading a row that has a reason fails, naming its keys."""
    message = F.concat_ws(" ", F.col(reason), *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys])
    return df.withColumn(reason, F.when(F.col(reason).isNotNull(), F.raise_error(message).cast("string")))


def explode_rows(df: DataFrame, keep: list, array: Column | str, value: str, pos: str = "_pos") -> DataFrame:
    """One row per array element, with its position.

    An inner explode makes the optimizer test the size of the array below it, which evaluates the
    whole array expression a second time. The outer form with a later filter evaluates it once.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, value)).where(F.col(pos).isNotNull())
    return rows.drop("_pos")
