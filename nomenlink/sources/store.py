"""Keyed tables that grow by versions: what earlier runs found out, kept for later ones.

A version holds rows and the keys that it speaks for, and is written beside the ones
before it. A key has the rows of the last version that names it, be they many or none. A
version counts from the moment that its line stands in the table ``versions``, which is
written last; what a run left unfinished is never read. Compaction writes the current rows
as a version that makes the earlier ones needless.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import shuffled

_LINES = "version long, folder string, whole boolean"


@dataclass(frozen=True)
class VersionedTable:
    """Rows of a fixed schema by ``keys``, which hold no nulls, under a shared folder."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    keys: tuple[str, ...]

    @classmethod
    def create(
        cls, spark: SparkSession, folder: str, schema: T.StructType | str, keys: Sequence[str]
    ) -> VersionedTable:
        """A table without versions; an error if the folder has one already."""
        parsed = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        spark.createDataFrame([], _LINES).write.mode("errorifexists").parquet(f"{folder}/versions")
        return cls(spark, folder, parsed, tuple(keys))

    def _lines(self) -> list:
        """The versions that count, from the last whole one on: one short line each."""
        lines = self.spark.read.schema(_LINES).parquet(f"{self.folder}/versions").collect()
        lines.sort(key=lambda r: r.version)
        whole = [i for i, r in enumerate(lines) if r.whole]
        return lines[whole[-1] if whole else 0 :]

    def version(self) -> int:
        """The number of the last version, 0 without any."""
        return max((r.version for r in self._lines()), default=0)

    def read(self) -> DataFrame:
        """The current rows."""
        now = self._current()
        rows = self._parts("rows", self.schema)
        return rows.join(shuffled(now), [*self.keys, "_version"], "left_semi").drop("_version")

    def known_keys(self) -> DataFrame:
        """Every key that some version speaks for, also those without rows."""
        return self._current().select(*self.keys)

    def _current(self) -> DataFrame:
        keys = T.StructType([f for f in self.schema.fields if f.name in self.keys])
        return self._parts("keys", keys).groupBy(*self.keys).agg(F.max("_version").alias("_version"))

    def _parts(self, part: str, schema: T.StructType) -> DataFrame:
        marked = T.StructType([*schema.fields, T.StructField("_version", T.LongType())])
        paths = [f"{r.folder}/{part}" for r in self._lines()]
        if not paths:
            return self.spark.createDataFrame([], marked)
        return self.spark.read.schema(marked).parquet(*paths)

    def upsert(self, rows: DataFrame, keys: DataFrame) -> int:
        """Replace all rows of the given keys by ``rows``, whose keys are among them."""
        return self._write(rows, keys.select(*self.keys).distinct(), whole=False)

    def compact(self) -> int:
        """Write the current rows as one version."""
        return self._write(self.read(), self.known_keys(), whole=True)

    def _write(self, rows: DataFrame, keys: DataFrame, whole: bool) -> int:
        version = self.version() + 1
        folder = f"{self.folder}/{version:06d}-{uuid.uuid4().hex}"
        stamp = F.lit(version).cast("long").alias("_version")
        rows.select(*self.schema.names, stamp).write.parquet(f"{folder}/rows")
        keys.select(*self.keys, stamp).write.parquet(f"{folder}/keys")
        line = self.spark.createDataFrame([(version, folder, whole)], _LINES)
        line.coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")
        return version
