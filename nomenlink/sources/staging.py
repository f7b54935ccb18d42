"""Tables written to shared storage between the steps of a long plan.

A staged table cuts lineage, survives the loss of any executor, and carries its
measured size, so that a later join can decide on a broadcast from a known number.
"""

from __future__ import annotations

import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runs import current_run

_SETTING = "spark.checkpoint.dir"


class Staged(NamedTuple):
    """A written table with its exact row count and its payload size in bytes."""

    frame: DataFrame
    rows: int
    size: int

    def where(self, condition: Column) -> Staged:
        """Part of the table; the measured numbers stay as upper bounds."""
        return Staged(self.frame.where(condition), self.rows, self.size)

    def select(self, *columns: Column | str) -> Staged:
        """Some columns of the table; the measured size stays as an upper bound."""
        return Staged(self.frame.select(*columns), self.rows, self.size)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for an unset local session."""
    configured = spark.conf.get(_SETTING, None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="nomenlink-"))
    return context.getCheckpointDir()


def written(df: DataFrame, label: str) -> DataFrame:
    """Write the frame once and read it back. Inside a run it is a step of that run."""
    if current_run() is not None:
        return stage(df, label).frame
    path = f"{shared_dir(df.sparkSession)}/nomenlink/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, label: str) -> Staged:
    """Write the frame once, measuring it on the way, and read it back.

    Inside a run it is a step of that run, and read only if it is whole already.
    """
    run, spark = current_run(), df.sparkSession
    columns = df.schema.json()
    if run is None:
        step = None
        path = f"{shared_dir(spark)}/nomenlink/{uuid.uuid4().hex}/{label}"
    else:
        step = run.next(label, columns)
        path = step.path
        if step.whole:
            return Staged(spark.read.schema(df.schema).parquet(path), step.rows, step.bytes)
    seen = Observation()
    measured = df.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.sum(_row_bytes(df)).alias("bytes"),
    )
    measured.write.parquet(path)
    found = seen.get
    rows, size = found["rows"], found["bytes"] or 0
    if run is not None:
        run.finish(step, label, columns, rows, size)
    return Staged(spark.read.schema(df.schema).parquet(path), rows, size)


def shuffled(df: DataFrame) -> DataFrame:
    """The frame as a side of a join that moves both sides by key.

    Spark judges a written table by its compressed files, and would send one of several
    million short rows whole to the driver and to every executor, once for each join.
    """
    return df.hint("merge")


def stage_unless_small(df: DataFrame, label: str, source: Staged, limit: int) -> Staged:
    """Stage a frame derived from a staged table, unless that bounds it to be small.

    The frame must have no more rows than its source, and only fixed-size columns next
    to strings of the source. Its size is then bounded without running it.
    """
    bound = source.size + source.rows * 16 * _leaves(df.schema)
    if bound <= limit:
        return Staged(df, source.rows, bound)
    return stage(df, label)


def _leaves(kind: T.DataType) -> int:
    """Number of values in a row, counting those inside structs."""
    if isinstance(kind, T.StructType):
        return sum(_leaves(field.dataType) for field in kind.fields)
    return 1


def _row_bytes(df: DataFrame) -> Column:
    """Payload of a row: string bytes, plus sixteen for every value and list."""
    return sum(
        (_payload(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields),
        F.lit(0).cast("bigint"),
    )


def _payload(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return sum((_payload(value[f.name], f.dataType) for f in kind.fields), F.lit(0))
    if isinstance(kind, T.StringType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        one = lambda total, x: total + _payload(x, kind.elementType)
        return F.coalesce(F.aggregate(value, F.lit(0).cast("bigint"), one), F.lit(0)) + 16
    return F.lit(16)
