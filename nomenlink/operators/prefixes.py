"""Texts that start with a name, found as intervals of a common order.

In the order of their bytes, the texts that start with a name stand next to each other.
Names and texts are put into one order together, where a name is the two bounds of its
interval. Range partitioning, a place inside each written partition and one count per
partition number all rows, as ``with_row_id`` does. Then a name and a text match if the
text's number lies between the name's bounds: rows are made for what lies there, and not
for every beginning that a text has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import shuffled, written

# Numbers that one row makes at once, so that no long list stands in a row.
_STEP = 4096
_PLACE = (1 << 33) - 1


def _bounds(name: Column, whole_words: bool) -> list[tuple[Column, Column]]:
    """The intervals of a name, each from its first to behind its last possible text."""
    start = name.cast("binary")
    if not whole_words:
        # No text has the byte FF.
        return [(start, F.concat(start, F.lit(b"\xff")))]
    # The name itself, and what goes on behind a blank.
    return [
        (start, F.concat(start, F.lit(b"\x00"))),
        (F.concat(start, F.lit(b" ")), F.concat(start, F.lit(b"!"))),
    ]


def prefix_matches(
    names: DataFrame, known: DataFrame, by: Sequence[str] = (), whole_words: bool = False
) -> DataFrame:
    """Every row of ``known`` whose ``text`` starts with a ``name``, with that name.

    Both sides need the columns ``by``, which must be equal and not null. With
    ``whole_words`` the name must be the text or end before a blank of it. ``names`` has
    each name once. Null names and texts match nothing. Gives ``by``, ``name``, ``text``
    and the other columns of ``known``.
    """
    other = [c for c in known.columns if c not in (*by, "text")]
    bounds = [
        F.struct(bound.alias("at"), F.lit(i).alias("interval"))
        for i, pair in enumerate(_bounds(F.col("name"), whole_words))
        for bound in pair
    ]
    asked = names.where(F.col("name").isNotNull()).select(*by, "name", F.inline(F.array(*bounds)))
    item = F.struct("text", *other)
    texts = known.where(F.col("text").isNotNull())
    texts = texts.select(*by, F.col("text").cast("binary").alias("at"), item.alias("item"))
    # A bound comes before an equal text; equal texts are told apart, so that they can part.
    both = asked.unionByName(texts, allowMissingColumns=True)
    both = both.withColumns(
        {"is_text": F.col("item").isNotNull(), "apart": F.xxhash64("name", "interval", "item")}
    )
    order = [*by, "at", "is_text", "apart"]
    placed = both.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(
        placed.select(
            *by, "name", "interval", "item", "is_text", F.monotonically_increasing_id().alias("place")
        ),
        "prefixes",
    )

    part = F.shiftright("place", 33).alias("part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # One row per partition that was written.
    numbered = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    numbered = numbered.withColumn("number", F.col("start") + F.col("place").bitwiseAND(F.lit(_PLACE)))

    low, high = F.col("low"), F.col("high")
    inside = numbered.where(~F.col("is_text")).groupBy(*by, "name", "interval").agg(
        (F.min("number") + 1).alias("low"), (F.max("number") - 1).alias("high")
    )
    inside = inside.where(low <= high).select(
        *by, "name", "high", F.explode(F.sequence(low, high, F.lit(_STEP))).alias("low")
    )
    last = F.least(high, low + (_STEP - 1))
    inside = inside.select(*by, "name", F.explode(F.sequence(low, last)).alias("number"))
    texts = numbered.where("is_text").select("number", "item")
    return inside.join(shuffled(texts), "number").select(*by, "name", "item.*")
