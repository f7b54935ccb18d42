"""From the chosen candidates to the two result tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import KINDS
from ..sources.staging import shuffled
from ..version import __version__
from .candidates import flag_ambiguous
from .groups import count_if
from .policies import APHIAID, CODE_COLUMNS, TSN

# Code column -> suffix of its column in the wide result.
_SUFFIXES = {
    "code": "", "code_svc": "_svc", "code_definitive": "_definitive",
    "code_src": "_src", "sugg_spelling": "_spelling",
}

WIDE_COLUMNS = tuple(
    f"{t.lower()}{suffix}" for t in (APHIAID, TSN) for suffix in _SUFFIXES.values()
)
FLAG_COLUMNS = tuple(f"{t.lower()}_multi_flag" for t in (APHIAID, TSN))
REPORT_COLUMNS = ("code_sugg", *CODE_COLUMNS[1:])
# The answer to a row's names, while both results are put together.
ANSWER = "_nomenlink_answer"
# Ambiguous candidates that an answer lists; of names with more they are joined.
LISTED = 1000


class Resolved(NamedTuple):
    """One row per input row, the candidates of every ambiguous input row, and what the
    crosswalk answered to the codes sent, for a later run's ``checked``. A result that was
    not asked for is null."""

    resolved: DataFrame | None
    ambiguous: DataFrame | None
    links: DataFrame | None = None


def id_source(debug: bool = False) -> Column:
    """The stamp of the version that produced a row."""
    return F.lit(f"nomenlink.resolve_names ({'DEBUG' if debug else 'v' + __version__})")


def wide_codes(cands: DataFrame) -> DataFrame:
    """One row per id: the code columns of both types, null and flagged if ambiguous."""
    return cands.groupBy("id").agg(*_wide_aggregates())


def _wide_aggregates() -> list[Column]:
    outputs, flags = [], []
    for code_type in (APHIAID, TSN):
        mine = F.col("code_type") == code_type
        n = count_if(mine)
        for column, suffix in _SUFFIXES.items():
            value = F.max(F.when(mine, F.col(column)))
            outputs.append(F.when(n == 1, value).alias(code_type.lower() + suffix))
        flags.append((n > 1).alias(f"{code_type.lower()}_multi_flag"))
    return [*outputs, *flags]


def answers(cands: DataFrame, listed: int = LISTED) -> DataFrame:
    """One row per id: ``wide_codes``, and its ambiguous candidates as the list ``report``.

    An id with more than ``listed`` of them has no list and ``unlisted`` set; its candidates
    are to be joined, so that no list grows with the authorities.
    """
    several = [F.when(F.col(f), F.col(f"_{f}")).otherwise(0) for f in FLAG_COLUMNS]
    counts = [
        count_if(F.col("code_type") == t).alias(f"_{f}") for t, f in zip((APHIAID, TSN), FLAG_COLUMNS)
    ]
    wide = cands.groupBy("id").agg(*_wide_aggregates(), *counts).withColumn("_n", sum(several))
    listable = wide.where(F.col("_n").between(1, listed)).select("id", *FLAG_COLUMNS)
    mine = F.when(F.col("code_type") == APHIAID, F.col(FLAG_COLUMNS[0])).otherwise(F.col(FLAG_COLUMNS[1]))
    entries = cands.join(shuffled(listable), "id").where(mine).withColumnRenamed("code", "code_sugg")
    lists = entries.groupBy("id").agg(F.collect_list(F.struct(*REPORT_COLUMNS)).alias("report"))
    return wide.join(shuffled(lists), "id", "left").select(
        "id", *WIDE_COLUMNS, *FLAG_COLUMNS, "report", (F.col("_n") > listed).alias("unlisted")
    )


def ambiguous_codes(cands: DataFrame) -> DataFrame:
    """The candidates of every id and code type that has more than one."""
    several = flag_ambiguous(cands).where("is_ambiguous")
    return several.withColumnRenamed("code", "code_sugg").select("id", *REPORT_COLUMNS)


def with_flags(wide: DataFrame) -> DataFrame:
    """The multi flags are never null: rows without any candidate are not ambiguous."""
    return wide.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in FLAG_COLUMNS})


def check_names_free(df: DataFrame) -> None:
    """The result columns must not hide columns of the input."""
    reserved = {*WIDE_COLUMNS, *FLAG_COLUMNS, *REPORT_COLUMNS, "id_src", ANSWER}
    taken = sorted(c for c in df.columns if c.lower() in reserved)
    if taken:
        raise ValueError(f"the input has columns of the result: {taken}")


def assemble(names: DataFrame, cands: DataFrame, debug: bool = False) -> Resolved:
    """Join chosen candidates to the rows that carry their ``id``, and drop the id."""
    check_names_free(names)
    stamp = id_source(debug).alias("id_src")
    inputs = [c for c in names.columns if c != "id"]
    wide = with_flags(names.join(shuffled(wide_codes(cands)), "id", "left"))
    report = names.join(shuffled(ambiguous_codes(cands)), "id", "right")
    return Resolved(
        wide.select(*inputs, *WIDE_COLUMNS, *FLAG_COLUMNS, stamp),
        report.select(*inputs, *REPORT_COLUMNS, stamp),
    )


def sent_codes(resolved: DataFrame) -> DataFrame:
    """The ``(code_type, code)`` pairs that a run sent through the crosswalk.

    A code is sent if a name gave it and the other type was not definitive by then: a TSN
    of a scientific name goes out before the common name can give an AphiaID.
    """
    sci, comm = KINDS
    aphia_sure = F.coalesce(F.col("aphiaid_definitive"), F.lit(False))
    tsn_sure = F.coalesce(F.col("tsn_definitive"), F.lit(False))
    tsn_was_known = tsn_sure & (F.col("tsn_src") == sci)
    aphia_was_known = aphia_sure & (
        (F.col("aphiaid_src") == sci)
        | ((F.col("aphiaid_src") == comm) & (F.col("tsn_src") == comm))
    )
    aphia = aphia_sure & (
        (F.col("aphiaid_src") == sci) | ((F.col("aphiaid_src") == comm) & ~tsn_was_known)
    )
    tsn = tsn_sure & F.col("tsn_src").isin(sci, comm) & ~aphia_was_known
    both = resolved.select(
        F.inline(
            F.array(
                F.struct(F.lit(APHIAID).alias("code_type"), F.when(aphia, F.col("aphiaid")).alias("code")),
                F.struct(F.lit(TSN).alias("code_type"), F.when(tsn, F.col("tsn")).alias("code")),
            )
        )
    )
    return both.where(F.col("code").isNotNull()).distinct()
