"""Run queries on Spark and their SQL on DuckDB, and compare all rows."""

from __future__ import annotations

import glob
import os
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from .registry import ORACLES, QUERIES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def differences(spark: SparkSession, sf_dir: str, name: str) -> dict:
    """Column names, row counts and the rows that only one side has."""
    started = time.time()
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    ours = Counter(tuple(r) for r in frame.select(*columns).collect())
    spark_seconds = time.time() - started
    started = time.time()
    connection = connect(sf_dir)
    cursor = connection.execute(ORACLES[name])
    theirs_columns = [d[0] for d in cursor.description]
    at = [theirs_columns.index(c) for c in columns if c in theirs_columns]
    theirs = Counter(tuple(r[i] for i in at) for r in cursor.fetchall())
    return {
        "columns": (columns, sorted(theirs_columns)),
        "rows": (ours.total(), theirs.total()),
        "only_spark": list((ours - theirs).elements()),
        "only_sql": list((theirs - ours).elements()),
        "seconds": (round(spark_seconds, 2), round(time.time() - started, 2)),
    }
