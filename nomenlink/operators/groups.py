"""Counting tests over groups of candidates.

Each test writes its rows, and joins a map-side aggregate of them back. So what gives the
rows runs once, however many tests follow each other, and rows move once, in the join. No
group is sorted or held as a window over it would be; where the join shuffles, adaptive
execution splits a large group over several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import shuffled, written


def count_if(predicate: Column) -> Column:
    """Rows where the predicate holds; null counts as false."""
    return F.count(F.when(predicate, F.lit(1)))


def with_group_stats(
    df: DataFrame, keys: Sequence[str], **stats: Column
) -> DataFrame:
    """Add aggregates of each row's group. The key columns must not hold nulls."""
    df = written(df, "grouped")
    groups = df.groupBy(*keys).agg(*(c.alias(name) for name, c in stats.items()))
    return df.join(shuffled(groups), list(keys))


def keep_if_any(df: DataFrame, keys: Sequence[str], predicate: Column) -> DataFrame:
    """Where some rows of a group satisfy the predicate keep those, else keep them all.

    Null counts as false, and the key columns must not hold nulls.
    """
    flagged = df.withColumn("_hit", F.coalesce(predicate, F.lit(False)))
    tested = with_group_stats(flagged, keys, _any=F.bool_or("_hit"))
    return tested.where(F.col("_hit") | ~F.col("_any")).drop("_hit", "_any")


def preference(*wishes: Column) -> Column:
    """A tier that is lower the earlier wishes a row meets; null counts as not met.

    Keeping the lowest tier of a group equals ``keep_if_any`` for one wish after the
    other, in a single pass.
    """
    tier = F.lit(0)
    for wish in wishes:
        tier = tier * 2 + F.when(F.coalesce(wish, F.lit(False)), 0).otherwise(1)
    return tier


def keep_best_tier(
    df: DataFrame, keys: Sequence[str], tier: str, **stats: Column
) -> DataFrame:
    """Keep each group's rows of the lowest tier, with aggregates over those rows."""
    df = written(df, "tiers")
    per_tier = df.groupBy(*keys, tier).agg(*(c.alias(n) for n, c in stats.items()))
    best = per_tier.groupBy(*keys).agg(F.min(F.struct(tier, *stats)).alias("_best"))
    best = best.select(*keys, "_best.*")
    return df.join(shuffled(best), [*keys, tier])
