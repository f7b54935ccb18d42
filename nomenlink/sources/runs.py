"""Runs that can be started again and tidied: a folder with the written steps of one run.

The folder is named by what the run is of: its inputs, parameters and the version of the
library. Each step is written to a place of its own, and counts from the moment that its
line stands in the table ``steps``. A run that is started again meets its steps in the same
order, takes those that count and goes on after the last of them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..version import __version__

_LINES = "number int, label string, columns string, path string, rows long, bytes long"


class Step(NamedTuple):
    """A step of a run: where it is, or is to be written, and its measures if it is whole."""

    number: int
    path: str
    whole: bool
    rows: int | None
    bytes: int | None


class Run:
    """The steps of one run. Only one driver may be at it at a time."""

    def __init__(self, spark: SparkSession, folder: str, inputs: dict[str, DataFrame], options: dict):
        """The run over these inputs with these options, new or begun, under ``folder``.

        Reads every input once, for its fingerprint.
        """
        of = {
            "version": __version__,
            # Hot keys are dealt out by this number, which decides on steps.
            "partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            "options": options,
            "inputs": {name: fingerprint(frame) for name, frame in inputs.items()},
        }
        self.spark = spark
        self.key = hashlib.sha256(json.dumps(of, sort_keys=True).encode()).hexdigest()
        self.folder = f"{folder}/run-{self.key[:32]}"
        self.reused: list[str] = []
        self.made: list[str] = []
        self._held: dict[int, object] = {}

    @contextmanager
    def steps(self):
        """Everything that the library writes inside is a step of this run."""
        # Appending no rows makes the table exist, and changes nothing of a begun run.
        self._note([])
        lines = self.spark.read.schema(_LINES).parquet(f"{self.folder}/steps").collect()
        self._held = {r["number"]: r for r in lines}
        self.reused, self.made = [], []
        token = _CURRENT.set(self)
        try:
            yield self
        finally:
            _CURRENT.reset(token)

    def next(self, label: str, columns: str) -> Step:
        """The next step, whole or still to be written."""
        number = len(self.reused) + len(self.made)
        held = self._held.get(number)
        if held is None:
            self.made.append(label)
            return Step(number, f"{self.folder}/{number:04d}-{uuid.uuid4().hex}/{label}", False, None, None)
        if (held["label"], held["columns"]) != (label, columns):
            raise RuntimeError(f"step {number} of {self.folder} is {held['label']}, not {label}")
        self.reused.append(label)
        return Step(number, held["path"], True, held["rows"], held["bytes"])

    def finish(self, step: Step, label: str, columns: str, rows: int, size: int) -> None:
        self._note([(step.number, label, columns, step.path, rows, size)])

    def _note(self, lines: list[tuple]) -> None:
        frame = self.spark.createDataFrame(lines, _LINES).coalesce(1)
        frame.write.mode("append").parquet(f"{self.folder}/steps")

    def remove(self) -> None:
        """Delete the run's folder, once its results are written elsewhere."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


_CURRENT: ContextVar[Run | None] = ContextVar("nomenlink_run", default=None)


def current_run() -> Run | None:
    return _CURRENT.get()


def fingerprint(frame: DataFrame) -> list[str]:
    """What tells apart two tables: columns, number of rows, and sums over row hashes.

    The order of rows does not matter, repeated rows do. One map-side aggregate.
    """
    # As JSON, a value stays with its column; a hash of columns passes over nulls.
    line = F.to_json(F.struct("*"))
    one, two = F.xxhash64(line), F.xxhash64(F.lit(1), line)
    found = frame.select(one.alias("a"), two.alias("b")).agg(
        F.count(F.lit(1)), F.bit_xor("a"), F.sum(F.col("a").cast("decimal(38,0)")),
        F.bit_xor("b"), F.sum(F.col("b").cast("decimal(38,0)")),
    )
    return [frame.schema.json(), *map(str, found.first())]
