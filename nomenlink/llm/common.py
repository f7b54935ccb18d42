"""Helpers that the operators share: written steps, input tables, batch sizes, hashes."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_dir

# Rows that a Python worker gets at once, and their bytes, which long texts reach first.
BATCH_ROWS = 256
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows and bytes of an Arrow batch, and so the memory of a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


# What a worker remembers and can load or compute again.
_REMEMBERED: list[Callable[[], None]] = []


def remembered(load: Callable) -> Callable:
    """Cache the results of a function until the end of a worker's partition."""
    cached = functools.cache(load)
    _REMEMBERED.append(cached.cache_clear)
    return cached


def forget_with(clear: Callable[[], None]) -> None:
    """Call this at the end of a worker's partition."""
    _REMEMBERED.append(clear)


def tidy(run: Callable) -> Callable:
    """Let a function over batches give its memory back when its partition is done.

    Spark reuses Python workers, and what one stage remembers, or its allocator keeps,
    would count against the next one.
    """

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            for clear in _REMEMBERED:
                clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied


def written(df: DataFrame, label: str, **options: int) -> DataFrame:
    """Write a step to the cluster's shared folder and read it back.

    This cuts lineage, survives lost executors, and makes generated ids stable. ``options``
    are those of the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/nomenlink-llm/{uuid.uuid4().hex}/{label}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_key(docs: DataFrame, *columns: str) -> DataFrame:
    """``absent, id`` in place of doc_id, and the given columns.

    A null doc_id becomes a flag and a zero, so that Python workers get exact integers
    and joins need no null-safe keys.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select(
        F.col("doc_id").isNull().alias("absent"),
        F.coalesce("doc_id", F.lit(0).cast(kind)).alias("id"),
        *columns,
    )


def doc_id() -> Column:
    """The doc_id that ``with_key`` took apart."""
    return F.when(~F.col("absent"), F.col("id")).alias("doc_id")


def id_remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 4


def is_held_out(doc_id: Column) -> Column:
    """True where the remainder is 2; a null id is not held out."""
    return F.coalesce(id_remainder(doc_id) == 2, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    """True where the remainder is known and not 2."""
    return F.coalesce(id_remainder(doc_id) != 2, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal bits in, equal and well spread bits out."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64).copy()
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def sorted_groups(
    batches: Iterator[pd.DataFrame], keys: list[str]
) -> Iterator[dict[str, np.ndarray]]:
    """Groups of equal keys, as arrays, from batches in which equal keys stand together.

    Many small groups cost less this way than as a frame each.
    """
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        new = np.zeros(len(batch), bool)
        for k in keys:
            new[1:] |= columns[k][1:] != columns[k][:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(batch)]
        for low, high in zip(cuts, cuts[1:]):
            part = {c: v[low:high] for c, v in columns.items()}
            if held and any(held[-1][k][0] != part[k][0] for k in keys):
                yield _joined(held)
                held = []
            held.append(part)
    if held:
        yield _joined(held)


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
