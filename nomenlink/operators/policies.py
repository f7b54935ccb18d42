"""Rules that decide which of the candidates found for a name are definitive.

A frame of records is keyed by ``name`` and ``kind``. A decided frame keeps the name and
holds ``code, code_svc, code_type, code_definitive, code_src, sugg_spelling``, with the
kind as source. Only a code that is not null can be definitive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import canonical, token_count
from ..sources.authorities import Authorities
from .groups import count_if, keep_best_tier, preference, with_group_stats
from .lookups import distinct_keys, records_of, tsns_of, with_usage

# --- fixed values: tags of the code types, services and sources in the results ---
APHIAID, TSN = "APHIAID", "TSN"
BEST_SERVICE, WORMS_SERVICE, ITIS_SERVICE = "TAXIZE & WORRMS", "WORRMS", "RITIS"

CODE_COLUMNS = (
    "code", "code_svc", "code_type", "code_definitive", "code_src", "sugg_spelling",
)


def tagged(
    code: Column, definitive: Column, sugg: Column, svc: str, code_type: str, src: Column
) -> list[Column]:
    """The code columns of a decided frame, with their constant tags."""
    definitive = F.coalesce(definitive, F.lit(False)) & code.isNotNull()
    return [
        code.cast("bigint").alias("code"),
        F.lit(svc).alias("code_svc"),
        F.lit(code_type).alias("code_type"),
        definitive.alias("code_definitive"),
        src.alias("code_src"),
        sugg.cast("string").alias("sugg_spelling"),
    ]


def decide_best(matches: DataFrame) -> DataFrame:
    """A verified best match is definitive exactly if it was no pattern match."""
    exact = ~F.coalesce(F.col("pattern_match"), F.lit(True))
    return matches.select(
        "name",
        *tagged(
            F.col("valid_aphia_id"), exact, canonical(F.col("valid_name")),
            BEST_SERVICE, APHIAID, F.col("kind"),
        ),
    )


def decide_worms(records: DataFrame) -> DataFrame:
    """Judge the WoRMS records of each name.

    A single record with a code wins, and is definitive. Otherwise accepted records go
    before the others, and a single accepted one is definitive. The added ``several``
    says that the first rule did not settle the name.
    """
    code = F.col("valid_aphia_id")
    accepted = F.coalesce(F.col("status") == "accepted", F.lit(False))
    judged = with_group_stats(
        records, ["name", "kind"],
        _n=F.count(F.lit(1)), _coded=F.count(code), _accepted=count_if(accepted),
    )
    n, coded, n_accepted = F.col("_n"), F.col("_coded"), F.col("_accepted")
    settled = (coded == 1) | (n == 1)
    kept = judged.where(
        F.when(coded == 1, code.isNotNull()).when(n_accepted > 0, accepted).otherwise(True)
    )
    return kept.select(
        "name",
        *tagged(
            code, settled | (n_accepted == 1), canonical(F.col("valid_name")),
            WORMS_SERVICE, APHIAID, F.col("kind"),
        ),
        (~settled).alias("several"),
    )


def narrow_by_scientific(candidates: DataFrame) -> DataFrame:
    """Let a row's scientific name choose among the several records of its common name.

    Expects the decided records fanned out to rows with ``sci_clean`` and ``matching``,
    the number of the several records that are spelled like it. One is definitive; more
    than one are kept, undecided; none changes nothing. Other rows stay as they are.
    """
    matching = F.when(
        F.col("several") & (F.col("code_src") == "common"),
        F.coalesce(F.col("matching"), F.lit(0)),
    ).otherwise(0)
    chosen = F.col("sugg_spelling").eqNullSafe(F.col("sci_clean"))
    kept = candidates.where((matching == 0) | chosen)
    decided = F.when(matching == 1, F.col("code").isNotNull()).otherwise(
        F.col("code_definitive")
    )
    return kept.withColumn("code_definitive", decided)


def decide_worms_common(pairs: DataFrame, decided: DataFrame) -> DataFrame:
    """Judge WoRMS records of common names per row, helped by its scientific name.

    ``pairs`` holds ``id, sci_clean, comm_clean``; ``decided`` comes from
    ``decide_worms``.
    """
    counts = (
        decided.where(F.col("several") & F.col("sugg_spelling").isNotNull())
        .groupBy(F.col("name").alias("comm_clean"), F.col("sugg_spelling").alias("sci_clean"))
        .agg(F.count(F.lit(1)).alias("matching"))
    )
    helped = pairs.select("id", "sci_clean", "comm_clean").join(
        counts, ["comm_clean", "sci_clean"], "left"
    )
    found = helped.join(decided.withColumnRenamed("name", "comm_clean"), "comm_clean")
    return narrow_by_scientific(found).select("id", *CODE_COLUMNS)


def decide_itis(found: DataFrame) -> DataFrame:
    """Judge the ITIS units of each name.

    Expects ``name, kind, tsn, found_name, is_valid, accepted_tsn, accepted_name``. Units
    with as many words as the name go before the others, then valid ones; a synonym
    becomes its accepted unit. A single candidate is definitive, else a single one
    spelled like the name, else none.
    """
    same_length = token_count(F.col("found_name")) == token_count(F.col("name"))
    is_synonym = F.col("accepted_tsn").isNotNull()
    units = found.select(
        "name", "kind",
        preference(same_length, F.col("is_valid")).alias("_tier"),
        F.coalesce("accepted_tsn", "tsn").alias("_code"),
        F.when(is_synonym, canonical(F.col("accepted_name")))
        .otherwise(F.col("found_name")).alias("_spelling"),
    )
    same = F.coalesce(F.col("_spelling") == F.col("name"), F.lit(False))
    judged = keep_best_tier(
        units, ["name", "kind"], "_tier", _n=F.count(F.lit(1)), _same=count_if(same)
    )
    by_spelling = (F.col("_n") > 1) & (F.col("_same") == 1)
    return (
        judged.where(~by_spelling | same)
        .select(
            "name",
            *tagged(
                F.col("_code"), (F.col("_n") == 1) | by_spelling, F.col("_spelling"),
                ITIS_SERVICE, TSN, F.col("kind"),
            ),
        )
        .distinct()
    )


def tsn_links(codes: DataFrame, authorities: Authorities) -> DataFrame:
    """What each distinct AphiaID in ``code`` leads to, keyed by it as ``sent``.

    A TSN is definitive if its usage is valid. A code without a TSN gives a null one.
    """
    found = with_usage(tsns_of(codes, authorities), authorities)
    return found.select(
        F.col("code").alias("sent"),
        *tagged(F.col("tsn"), F.col("is_valid"), F.lit(None), WORMS_SERVICE, TSN, F.lit(APHIAID)),
    )


def aphia_links(codes: DataFrame, authorities: Authorities) -> DataFrame:
    """What each distinct TSN in ``code`` leads to, keyed by it as ``sent``.

    The valid id of a single record is definitive; those of several records are not. A
    record without one gives its own id, and a TSN without a record a null one.
    """
    valid = F.col("valid_aphia_id").isNotNull()
    records = with_group_stats(
        records_of(codes, authorities), ["code"], _records=F.count("aphia_id")
    )
    return records.select(
        F.col("code").alias("sent"),
        *tagged(
            F.coalesce("valid_aphia_id", "aphia_id"), valid & (F.col("_records") == 1),
            F.when(valid, canonical(F.col("valid_name"))), WORMS_SERVICE, APHIAID, F.lit(TSN),
        ),
    )


def xwalk_tsn(rows: DataFrame, authorities: Authorities) -> DataFrame:
    """Cross over from AphiaIDs to TSNs: codes go out once, answers to all their rows."""
    links = tsn_links(distinct_keys(rows, "code", "code"), authorities)
    return rows.withColumnRenamed("code", "sent").join(links, "sent").drop("sent")


def xwalk_aphia(rows: DataFrame, authorities: Authorities) -> DataFrame:
    """Cross over from TSNs to AphiaIDs: codes go out once, answers to all their rows."""
    links = aphia_links(distinct_keys(rows, "code", "code"), authorities)
    return rows.withColumnRenamed("code", "sent").join(links, "sent").drop("sent")
