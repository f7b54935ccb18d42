"""The table of names to resolve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import clean_names, without_scientific
from .staging import stage


def check_columns(df: DataFrame, sci_col: str | None, comm_col: str | None) -> list[str]:
    """The name columns in use: at least one, and all present."""
    used = [c for c in (sci_col, comm_col) if c is not None]
    if not used:
        raise ValueError("name at least one of sci_col and comm_col")
    if len(used) == 2 and sci_col.lower() == comm_col.lower():
        raise ValueError("sci_col and comm_col must be different columns")
    missing = [c for c in used if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    other = [c for c in used if not isinstance(df.schema[c].dataType, T.StringType)]
    if other:
        raise ValueError(f"not text columns: {other}")
    return used


def distinct_names(
    df: DataFrame,
    sci_col: str | None,
    comm_col: str | None,
    sci_filters: Sequence[str] = (),
    comm_filters: Sequence[str] = (),
) -> DataFrame:
    """Each distinct raw name pair, its row count ``n``, and its cleaned names.

    Everything later depends on the pair alone, so the input shrinks here, by a
    map-side aggregate, and repeated names are cleaned and looked up once. A missing
    column reads as null.
    """
    check_columns(df, sci_col, comm_col)
    sci = F.col(sci_col) if sci_col else F.lit(None).cast("string")
    comm = F.col(comm_col) if comm_col else F.lit(None).cast("string")
    pairs = (
        df.select(sci.alias("sci_raw"), comm.alias("comm_raw"))
        .groupBy("sci_raw", "comm_raw")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    pairs = pairs.withColumn(
        "comm_own", without_scientific(F.col("sci_raw"), F.col("comm_raw"))
    )
    pairs = clean_names(pairs, "sci_raw", "scientific", sci_filters, "sci_clean")
    pairs = clean_names(pairs, "comm_own", "common", comm_filters, "comm_clean")
    return pairs.drop("comm_own")


def with_row_id(
    df: DataFrame, order_by: Sequence[str] = (), output: str = "id"
) -> DataFrame:
    """Add dense row numbers 1..n: in the order of unique columns, or as the rows lie.

    The rows are staged once with their place inside their partition, which makes the
    numbers stable. Only one count per partition meets in the window that turns the
    places into numbers; the rows themselves are never gathered.
    """
    if output in df.columns:
        raise ValueError(f"the input already has a column {output!r}")
    ordered = df.orderBy(*order_by) if order_by else df
    # The generated id holds the partition in its upper bits, the place in the lower 33.
    placed = stage(ordered.withColumn("_at", F.monotonically_increasing_id()), "rows").frame
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    # One row per input partition, so the broadcast is bounded by the task count.
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(
            output, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
        )
        .drop("_part", "_at", "_start")
        .select(output, *df.columns)
    )
