"""Joins of many rows to a small or large lookup, safe against hot keys."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import Staged, shuffled, stage, written

# A lookup is broadcast only up to this measured size.
BROADCAST_BYTES = 32 << 20
_HASH, _SALT, _SPREAD = "_join_hash", "_join_salt", "_join_spread"


def null_safe(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> Column:
    """Equality on all key pairs in which null equals null."""
    return reduce(
        lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in keys]
    )


def attach(
    rows: DataFrame,
    lookup: Staged,
    keys: list[tuple[str, str]],
    how: str,
    counts: Callable[[], DataFrame],
    broadcast_bytes: int = BROADCAST_BYTES,
    null_keys: bool = True,
) -> DataFrame:
    """Join rows to a staged lookup, ``inner`` or ``left``, dropping the lookup's keys.

    ``keys`` pairs row columns with lookup columns; null matches null. Where no key of the
    lookup is null, ``null_keys`` may be false: rows with a null key then match nothing, and
    are spread over the partitions instead of being dealt out as a hot key. A lookup of
    checked size is broadcast, and the rows do not move. Beyond that size the rows are
    read once and shuffle by key. ``counts`` gives the rows per key (the lookup's key
    names and ``n``): a key with more rows than a mean shuffle partition is dealt out to
    as many partitions as its rows would fill, and its part of the lookup is repeated in
    each. Fewer keys than there are partitions can be that hot, whatever their size.

    The share of a row comes from a number written with it. So a task that runs again
    after a loss deals the same rows to the same shares, in whatever order it gets them,
    and equal rows have shares of their own.
    """
    if lookup.size <= broadcast_bytes:
        return _joined(rows, F.broadcast(lookup.frame), keys, how)

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hash_of = F.xxhash64(*(b for _, b in keys)).alias(_HASH)
    per_key = counts() if null_keys else counts().dropna(subset=[b for _, b in keys])
    total = per_key.agg(F.sum("n")).first()[0] or 0
    mean = max(1, total // partitions)
    per_hash = per_key.groupBy(hash_of).agg(F.sum("n").alias("n"))
    hot = per_hash.where(F.col("n") > mean)
    hot = stage(hot.select(_HASH, F.ceil(F.col("n") / mean).cast("int").alias("_shares")), "hot")
    on, table = keys, lookup.frame
    if not null_keys:
        rows, table = _spread(rows, table, keys, partitions)
        on = [*keys, (_SPREAD, _SPREAD)]
    if hot.rows == 0:
        return _joined(rows, shuffled(table), on, how).drop(_SPREAD)
    # One hash and one number for each hot key, so at most sixteen bytes per partition.
    shares = F.broadcast(hot.frame)
    one = F.coalesce("_shares", F.lit(1))
    dealt = written(deal(rows, hot.frame, [a for a, _ in keys]), "dealt")
    repeated = table.withColumn(_HASH, hash_of).join(shares, _HASH, "left")
    repeated = repeated.withColumn(_SALT, F.explode(F.sequence(F.lit(0), one - 1)))
    repeated = repeated.drop(_HASH, "_shares")
    return _joined(dealt, shuffled(repeated), [*on, (_SALT, _SALT)], how).drop(_SALT, _SPREAD)


def _spread(
    rows: DataFrame, table: DataFrame, keys: list[tuple[str, str]], partitions: int
) -> tuple[DataFrame, DataFrame]:
    """Give rows with a null key a number that no row of the lookup has; others have null."""
    missing = reduce(lambda a, b: a | b, [F.col(a).isNull() for a, _ in keys])
    number = F.pmod(F.xxhash64(*rows.columns), F.lit(partitions)).cast("int")
    # No key of the lookup is null, so this is null there as well.
    other = F.when(F.col(keys[0][1]).isNull(), F.lit(-1))
    return rows.withColumn(_SPREAD, F.when(missing, number)), table.withColumn(_SPREAD, other)


def deal(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Add the share of each row, by its turn among the rows as they now lie.

    ``hot`` has the hash of every hot key and its number of shares. The turn depends on
    the order of the rows, so the result must be written before anything is joined to it.
    """
    shares = F.coalesce("_shares", F.lit(1)).cast("bigint")
    turn = F.pmod(F.monotonically_increasing_id(), shares).cast("int")
    marked = rows.withColumn(_HASH, F.xxhash64(*keys)).join(F.broadcast(hot), _HASH, "left")
    return marked.withColumn(_SALT, turn).drop(_HASH, "_shares")


def _joined(
    rows: DataFrame, lookup: DataFrame, keys: list[tuple[str, str]], how: str
) -> DataFrame:
    # Rename the lookup's keys so that they cannot clash with the row columns.
    named = lookup.withColumnsRenamed({b: f"_key_{b}" for _, b in keys})
    on = null_safe(rows, named, [(a, f"_key_{b}") for a, b in keys])
    return rows.join(named, on, how).drop(*(f"_key_{b}" for _, b in keys))
