"""Run registered queries on Spark and their reference SQL on DuckDB and compare the rows.

``python tests/compare.py [folder of tables] [query name or prefix ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

from workload.fixtures import BASE


TIMES: list[float] = []  # seconds to build, to run on Spark, to run on DuckDB


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("talentweave-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}")
    return value


def rows_of(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def difference(spark, con, folder: str, build, sql: str) -> str | None:
    """None when both sides give the same columns and rows, else what differs."""
    marks = [time.time()]
    df = build(spark, folder)
    marks.append(time.time())
    names, got = rows_of(df.columns, df.collect())
    marks.append(time.time())
    cursor = con.execute(sql)
    wanted_names, wanted = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    marks.append(time.time())
    TIMES[:] = [b - a for a, b in zip(marks, marks[1:])]
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if got != wanted:
        extra, lost = list((got - wanted).elements()), list((wanted - got).elements())
        return (
            f"{sum(got.values())} rows vs {sum(wanted.values())}; {len(extra)} only in Spark {sorted(extra)[:2]}; "
            f"{len(lost)} only in DuckDB {sorted(lost)[:2]}"
        )
    return None if got else "both empty"


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark, con = session(), database(folder)
    oracles, bad = entry.oracle_sql(), []
    for name, build in entry.queries().items():
        if wanted and not any(name == x or (x.endswith("*") and name.startswith(x[:-1])) for x in wanted):
            continue
        start = time.time()
        try:
            result = difference(spark, con, folder, build, oracles[name]) if name in oracles else "no oracle"
        except Exception as exc:  # noqa: BLE001
            result = f"{type(exc).__name__}: {str(exc)[:700]}"
        print(f"{name:28s} {time.time() - start:6.1f}s {' '.join(f'{t:.1f}' for t in TIMES):>14s}  {'ok' if result is None else result}", flush=True)
        if result not in (None, "no oracle"):
            bad.append(name)
    print("bad:", bad)
