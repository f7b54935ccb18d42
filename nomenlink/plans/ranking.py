"""Which search answers for a pair of names, decided before any candidate is attached.

A search that would run only where the searches before it failed becomes a rank:

====  ==================================  ==================================
rank  AphiaID found by                    TSN found by
====  ==================================  ==================================
1     best match, scientific name         crosswalk of AphiaIDs 1 and 2
2     WoRMS records, scientific name      ITIS, scientific name
3     crosswalk of TSNs 2                 crosswalk of AphiaIDs 4 and 5
4     best match, common name             ITIS, common name
5     WoRMS records, common name
6     crosswalk of TSNs 4
====  ==================================  ==================================

The first rank with a definitive answer wins, and a crosswalk is used only where the
other code type is definitive and this one is not. Without a definitive answer the last
rank that gave a code wins, as a later search replaces an earlier doubtful answer.
Every name and code has one row of facts, so all this is column logic on the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import KINDS
from ..operators.policies import APHIAID, TSN
from ..sources.staging import shuffled

# --- fixed values: ranks of the searches by name, per code type and kind of name ---
BEST_RANK = {"scientific": 1, "common": 4}
WORMS_RANK = {"scientific": 2, "common": 5}
ITIS_RANK = {"scientific": 2, "common": 4}
# --- fixed values: ranks of the crosswalks from the other type's code of that kind ---
TO_TSN_RANK = {"scientific": 1, "common": 3}
TO_APHIA_RANK = {"scientific": 3, "common": 6}


def with_link_facts(decided: DataFrame, links: DataFrame) -> DataFrame:
    """Add ``link_sure, link_any``: what the crosswalk gives for a candidate's code."""
    facts = links.groupBy(
        F.col("sent").alias("code"),
        F.when(F.col("code_type") == TSN, APHIAID).otherwise(TSN).alias("code_type"),
    ).agg(
        F.bool_or("code_definitive").alias("link_sure"),
        (F.count("code") > 0).alias("link_any"),
    )
    # Candidates without a code would all meet in one task of the join.
    coded = decided.where(F.col("code").isNotNull())
    coded = coded.join(shuffled(facts), ["code", "code_type"], "left")
    return coded.unionByName(decided.where(F.col("code").isNull()), allowMissingColumns=True)


def _facts(rows: Column, sure: Column) -> Column:
    """One struct of facts on a search: its answers, and where its sure code leads."""
    mine = rows & sure
    return F.struct(
        F.coalesce(F.bool_or(mine), F.lit(False)).alias("sure"),
        (F.count(F.when(rows, F.col("code"))) > 0).alias("any"),
        F.max(F.when(mine, F.col("code"))).alias("code"),
        F.coalesce(F.bool_or(mine & F.col("link_sure")), F.lit(False)).alias("link_sure"),
        F.coalesce(F.bool_or(mine & F.col("link_any")), F.lit(False)).alias("link_any"),
    )


def name_facts(linked: DataFrame) -> DataFrame:
    """One row per name and kind: ``best``, ``worms`` and ``itis`` facts."""
    sure = F.col("code_definitive")
    is_aphia = F.col("code_type") == APHIAID
    is_best = F.col("rank").isin(*BEST_RANK.values())
    return linked.groupBy("name", F.col("code_src").alias("kind")).agg(
        _facts(is_aphia & is_best, sure).alias("best"),
        _facts(is_aphia & ~is_best, sure).alias("worms"),
        _facts(~is_aphia, sure).alias("itis"),
    )


def spelling_facts(linked: DataFrame) -> DataFrame:
    """One row per common name and spelling of its several WoRMS records.

    Gives ``matching``, their number, and the facts that hold when a scientific name
    has that spelling: a single match is definitive.
    """
    several = linked.where(
        F.col("several")
        & (F.col("code_src") == "common")
        & F.col("sugg_spelling").isNotNull()
    )
    facts = several.groupBy(
        F.col("name").alias("comm_clean"), F.col("sugg_spelling").alias("sci_clean")
    ).agg(
        F.count(F.lit(1)).alias("matching"),
        _facts(F.lit(True), F.col("code").isNotNull()).alias("one"),
    )
    only = (F.col("matching") == 1) & F.col("one.sure")
    return facts.select(
        "comm_clean", "sci_clean", "matching",
        F.struct(
            only.alias("sure"), F.col("one.any").alias("any"),
            F.when(only, F.col("one.code")).alias("code"),
            (only & F.col("one.link_sure")).alias("link_sure"),
            (only & F.col("one.link_any")).alias("link_any"),
        ).alias("spelled"),
    )


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    """Choose the rank of both code types for every pair.

    Expects ``sci_best, sci_itis, …, comm_worms`` and ``matching, spelled``, null where
    the pair has no such name. Adds ``aphia_rank, tsn_rank``, and in ``aphia_sent,
    tsn_sent`` the code to cross over from where that rank is a crosswalk.
    """

    def holds(fact: str) -> Column:
        return F.coalesce(F.col(fact), F.lit(False))

    def first_sure(best: str, worms: str) -> Column:
        return F.when(holds(f"{best}.sure"), F.col(best)).when(
            holds(f"{worms}.sure"), F.col(worms)
        )

    sci, comm = KINDS
    pairs = pairs.withColumn(
        "comm_worms",
        F.when(F.col("matching") > 0, F.col("spelled")).otherwise(F.col("comm_worms")),
    )
    pairs = pairs.withColumns(
        {
            "sci_aphia": first_sure("sci_best", "sci_worms"),
            "comm_aphia": first_sure("comm_best", "comm_worms"),
        }
    )
    # The scientific names, then the crosswalks from what they gave.
    pairs = pairs.withColumn(
        "tsn_sci",
        F.when(holds("sci_aphia.link_sure"), TO_TSN_RANK[sci])
        .when(holds("sci_itis.sure"), ITIS_RANK[sci]),
    )
    pairs = pairs.withColumn(
        "aphia_sci",
        F.when(holds("sci_best.sure"), BEST_RANK[sci])
        .when(holds("sci_worms.sure"), WORMS_RANK[sci])
        .when(
            (F.col("tsn_sci") == ITIS_RANK[sci]) & holds("sci_itis.link_sure"),
            TO_APHIA_RANK[sci],
        ),
    )
    # The common names, where the code type is still open, and their crosswalks.
    pairs = pairs.withColumn(
        "aphia_sure",
        F.coalesce(
            "aphia_sci",
            F.when(holds("comm_best.sure"), BEST_RANK[comm])
            .when(holds("comm_worms.sure"), WORMS_RANK[comm]),
        ),
    )
    by_common = F.col("aphia_sci").isNull() & F.col("aphia_sure").isNotNull()
    pairs = pairs.withColumn(
        "tsn_sure",
        F.coalesce(
            "tsn_sci",
            F.when(by_common & holds("comm_aphia.link_sure"), TO_TSN_RANK[comm])
            .when(holds("comm_itis.sure"), ITIS_RANK[comm]),
        ),
    )
    sci_tsn = F.col("tsn_sure") == ITIS_RANK[sci]
    comm_tsn = F.col("tsn_sure") == ITIS_RANK[comm]
    pairs = pairs.withColumns(
        {
            "aphia_rank": F.coalesce(
                "aphia_sure",
                F.when(comm_tsn & holds("comm_itis.link_any"), TO_APHIA_RANK[comm])
                .when(holds("comm_worms.any"), WORMS_RANK[comm])
                .when(holds("comm_best.any"), BEST_RANK[comm])
                .when(sci_tsn & holds("sci_itis.link_any"), TO_APHIA_RANK[sci])
                .when(holds("sci_worms.any"), WORMS_RANK[sci])
                .when(holds("sci_best.any"), BEST_RANK[sci]),
            ),
            "tsn_rank": F.coalesce(
                "tsn_sure",
                F.when(holds("comm_itis.any"), ITIS_RANK[comm])
                .when(by_common & holds("comm_aphia.link_any"), TO_TSN_RANK[comm])
                .when(holds("sci_itis.any"), ITIS_RANK[sci])
                .when(holds("sci_aphia.link_any"), TO_TSN_RANK[sci]),
            ),
        }
    )
    return pairs.select(
        "id", "sci_clean", "comm_clean", "matching", "aphia_rank", "tsn_rank",
        F.when(F.col("aphia_rank") == TO_APHIA_RANK[sci], F.col("sci_itis.code"))
        .when(F.col("aphia_rank") == TO_APHIA_RANK[comm], F.col("comm_itis.code"))
        .alias("aphia_sent"),
        F.when(F.col("tsn_rank") == TO_TSN_RANK[sci], F.col("sci_aphia.code"))
        .when(F.col("tsn_rank") == TO_TSN_RANK[comm], F.col("comm_aphia.code"))
        .alias("tsn_sent"),
    )


def searches(ranked: DataFrame) -> DataFrame:
    """The chosen search of every pair and code type, as one row each.

    Gives the ``name`` whose candidates to take, or the ``sent`` code whose links.
    """
    long = ranked.select(
        "id", "sci_clean", "comm_clean", "matching",
        F.inline(
            F.array(
                F.struct(
                    F.lit(APHIAID).alias("code_type"),
                    F.col("aphia_rank").alias("rank"), F.col("aphia_sent").alias("sent"),
                ),
                F.struct(
                    F.lit(TSN).alias("code_type"),
                    F.col("tsn_rank").alias("rank"), F.col("tsn_sent").alias("sent"),
                ),
            )
        ),
    ).where(F.col("rank").isNotNull())
    last_sci = max(WORMS_RANK["scientific"], ITIS_RANK["scientific"])
    name = F.when(F.col("rank") <= last_sci, F.col("sci_clean")).otherwise(F.col("comm_clean"))
    return long.withColumn("name", F.when(F.col("sent").isNull(), name))
