"""Work on the long table of candidates: one row per id, code type and code."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import review_suggestion
from ..sources.staging import shuffled, written
from .groups import keep_if_any, with_group_stats
from .policies import CODE_COLUMNS

CANDIDATE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("sci_clean", T.StringType()),
        T.StructField("comm_clean", T.StringType()),
        T.StructField("code", T.LongType()),
        T.StructField("code_svc", T.StringType()),
        T.StructField("code_type", T.StringType()),
        T.StructField("code_definitive", T.BooleanType()),
        T.StructField("code_src", T.StringType()),
        T.StructField("sugg_spelling", T.StringType()),
    ]
)


class Split(NamedTuple):
    known: DataFrame
    unknown: DataFrame


def _is_definitive():
    return F.coalesce(F.col("code_definitive"), F.lit(False))


def select_candidates(cands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Choose one ``rank`` of candidates per key and code type.

    The first rank with a definitive candidate wins, with its definitive rows. Without
    one, the last rank that answered with a code wins, as a later search replaces an
    earlier doubtful answer. Candidates without a code never displace others.
    """
    sure = _is_definitive()
    ranked = with_group_stats(
        cands.where(F.col("code").isNotNull()), [*keys, "code_type"],
        _first=F.min(F.when(sure, F.col("rank"))), _last=F.max("rank"),
    )
    first = F.col("_first")
    chosen = F.when(first.isNotNull(), sure & (F.col("rank") == first)).otherwise(
        F.col("rank") == F.col("_last")
    )
    return ranked.where(chosen).drop("_first", "_last")


def split_known_unknown(cands: DataFrame, master: DataFrame | None = None) -> Split:
    """Part definitive candidates from the others, and drop unknowns already known.

    An unknown is dropped when its id has a definitive code of the same type. The
    services that gave the same unknown code are combined. With ``master``, its names are
    attached: definitive candidates of ids that it lacks are left out, unknowns stay with
    null names.
    """
    listed = F.lit(True)
    if master is not None:
        names = master.select("id", "sci_clean", "comm_clean", F.lit(True).alias("_listed"))
        cands = names.join(shuffled(cands.select("id", *CODE_COLUMNS)), "id", "right")
        listed = F.col("_listed").isNotNull()
    # Both parts read the candidates, and the unknown ones read the known.
    cands = written(cands, "to_split")
    known = written(cands.where(_is_definitive() & listed).drop("_listed").distinct(), "known")
    cands = cands.drop("_listed")
    resolved = known.select(
        F.col("id").alias("_id"), F.col("code_type").alias("_type")
    ).distinct()
    unknown = cands.where(~_is_definitive())
    unknown = unknown.join(
        shuffled(resolved),
        (unknown["id"] == resolved["_id"])
        & unknown["code_type"].eqNullSafe(resolved["_type"]),
        "left_anti",
    )
    return Split(known, combine_services(unknown))


def combine_services(cands: DataFrame) -> DataFrame:
    """One row per distinct candidate, with all services that gave it, in order.

    Nulls group together, so no candidate is lost for a missing value.
    """
    same = [c for c in cands.columns if c != "code_svc"]
    services = F.array_join(F.array_sort(F.collect_set("code_svc")), ",")
    combined = cands.groupBy(*same).agg(
        F.when(F.count("code_svc") > 0, services).alias("code_svc")
    )
    return combined.select(*cands.columns)


def review_spelling(cands: DataFrame) -> DataFrame:
    """Null the suggestions that only repeat the row's own cleaned names."""
    reviewed = review_suggestion(
        F.col("sugg_spelling"), F.col("sci_clean"), F.col("comm_clean")
    )
    return cands.withColumn("sugg_spelling", reviewed)


def prefer_exact_spelling(cands: DataFrame) -> DataFrame:
    """Among undecided candidates prefer those that need no other spelling."""
    exact = _is_definitive() | F.col("sugg_spelling").isNull()
    return keep_if_any(cands, ["id", "code_type"], exact)


def flag_ambiguous(cands: DataFrame) -> DataFrame:
    """Add ``is_ambiguous``: the id has more than one candidate of this type."""
    counted = with_group_stats(cands, ["id", "code_type"], _n=F.count(F.lit(1)))
    return counted.withColumn("is_ambiguous", F.col("_n") > 1).drop("_n")


def unchecked_codes(codes: DataFrame, checked: DataFrame | None) -> DataFrame:
    """Leave out ``(code_type, code)`` pairs that an earlier run has sent already."""
    if checked is None:
        return codes
    return codes.join(shuffled(checked), ["code_type", "code"], "left_anti")
