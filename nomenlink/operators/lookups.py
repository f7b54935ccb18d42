"""Searches of the authority snapshots, as joins from a frame of distinct names.

Every search takes a frame with one distinct, non-null ``name`` per row, and says
whether they are ``scientific`` or ``common``. It returns the records found, keyed by
the name and that ``kind``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.authorities import Authorities
from ..sources.staging import shuffled, written
from .prefixes import prefix_matches


def distinct_keys(df: DataFrame, col: str, output: str = "name") -> DataFrame:
    """Each non-null value of a column once: what is worth looking up."""
    return df.select(F.col(col).alias(output)).where(F.col(output).isNotNull()).distinct()


def search_worms(names: DataFrame, authorities: Authorities, kind: str) -> DataFrame:
    """WoRMS records whose scientific or vernacular name is exactly the name.

    Gives ``name, kind, status, valid_aphia_id, valid_name``, one row per record.
    """
    if kind == "scientific":
        taxa = authorities.taxa_by_name
        found = names.join(taxa, names["name"] == taxa["scientificname"])
    else:
        taxa = authorities.worms_taxa
        known = authorities.worms_vernacular
        ids = names.join(known, names["name"] == known["vernacular"])
        found = ids.select("name", "aphia_id").distinct().join(taxa, "aphia_id")
    # A repeated line of a snapshot is no second record.
    records = found.select("name", "aphia_id", "status", "valid_aphia_id", "valid_name").distinct()
    return records.select(
        "name", F.lit(kind).alias("kind"), "status", "valid_aphia_id", "valid_name"
    )


def best_match(names: DataFrame, authorities: Authorities, kind: str) -> DataFrame:
    """The single best WoRMS id of each name that has one.

    Gives ``name, kind, aphia_id, multiple_matches, pattern_match``. An exact match beats a
    pattern match, then the lowest id wins.
    """
    known = authorities.worms_best_match
    if known is None:
        return derive_best_match(names, authorities, kind)
    inexact = F.coalesce(F.col("pattern_match"), F.lit(True))
    # A least struct is found map-side, so no name's matches are gathered or sorted.
    return (
        names.join(known, names["name"] == known["query"])
        .distinct()
        .groupBy("name")
        .agg(
            F.min(F.struct(inexact.alias("inexact"), "aphia_id", "pattern_match")).alias("best"),
            ((F.count(F.lit(1)) > 1) | F.coalesce(F.bool_or("multiple_matches"), F.lit(False)))
            .alias("multiple_matches"),
        )
        .select(
            "name", F.lit(kind).alias("kind"), "best.aphia_id", "multiple_matches",
            "best.pattern_match",
        )
    )


def derive_best_match(names: DataFrame, authorities: Authorities, kind: str) -> DataFrame:
    """The best match where the snapshot has no ready table of them.

    An authority name matches exactly, or by pattern when it starts with the name.
    """
    if kind == "scientific":
        known = authorities.worms_taxa.select(F.col("scientificname").alias("text"), "aphia_id")
    else:
        known = authorities.worms_vernacular.select(F.col("vernacular").alias("text"), "aphia_id")
    found = prefix_matches(names.select("name"), known.distinct())
    best = found.groupBy("name").agg(
        F.min(F.struct((F.col("text") != F.col("name")).alias("pattern_match"), "aphia_id")).alias("best"),
        (F.count(F.lit(1)) > 1).alias("multiple_matches"),
    )
    return best.select(
        "name", F.lit(kind).alias("kind"), "best.aphia_id", "multiple_matches",
        "best.pattern_match",
    )


def verify_match(matches: DataFrame, authorities: Authorities) -> DataFrame:
    """Add the valid id and name of the matched record; both null unless both exist."""
    matches = written(matches, "matches")
    taxa = authorities.worms_taxa.select("aphia_id", "valid_aphia_id", "valid_name")
    both = F.col("valid_aphia_id").isNotNull() & F.col("valid_name").isNotNull()
    taxa = taxa.join(matches.select("aphia_id").distinct(), "aphia_id", "left_semi").distinct()
    found = matches.join(taxa, "aphia_id", "left")
    return found.select(
        *matches.columns,
        F.when(both, F.col("valid_aphia_id")).alias("valid_aphia_id"),
        F.when(both, F.col("valid_name")).alias("valid_name"),
    )


def search_itis_shortest(
    names: DataFrame, authorities: Authorities, kind: str | None = None
) -> DataFrame:
    """The part of ``search_itis`` that its decision keeps.

    A unit with as many words as the name is the name itself. So names that are units
    find those, by a plain join; only the others are searched by leading words.
    """
    names = _with_kind(names, kind)
    known = _itis_known(authorities).withColumn("name", F.col("text"))
    exact = names.join(known, ["kind", "name"])
    exact = exact.select("name", "kind", "tsn", F.col("text").alias("found_name")).distinct()
    exact = written(exact, "exact")
    others = names.join(exact.select("kind", "name"), ["kind", "name"], "left_anti")
    return exact.unionByName(search_itis(others, authorities))


def _with_kind(names: DataFrame, kind: str | None) -> DataFrame:
    return names if kind is None else names.select("name", F.lit(kind).alias("kind"))


def _itis_known(authorities: Authorities) -> DataFrame:
    """``kind, text, tsn`` of all unit names."""
    sci, comm = authorities.itis_names, authorities.itis_vernacular
    return sci.select(
        F.lit("scientific").alias("kind"), F.col("combined_name").alias("text"), "tsn"
    ).unionByName(
        comm.select(F.lit("common").alias("kind"), F.col("common_name").alias("text"), "tsn")
    )


def search_itis(
    names: DataFrame, authorities: Authorities, kind: str | None = None
) -> DataFrame:
    """ITIS units whose name is the searched name or continues it by whole words.

    So a genus finds its species and a species its subspecies. Without a ``kind``, each
    name comes with its own. Gives ``name, kind, tsn, found_name``, without duplicates.
    """
    known = _itis_known(authorities)
    if kind is not None:
        known = known.where(F.col("kind") == kind)
    found = prefix_matches(
        _with_kind(names, kind), known.distinct(), by=["kind"], whole_words=True
    )
    return found.select("name", "kind", "tsn", F.col("text").alias("found_name"))


def usage_ratings(authorities: Authorities) -> DataFrame:
    """Whether the usage rating of each TSN is ``valid``; a null rating is not."""
    return _ratings(authorities.itis_units)


def _ratings(units: DataFrame) -> DataFrame:
    valid = F.coalesce(F.col("usage_rating") == "valid", F.lit(False))
    return units.groupBy("tsn").agg(F.bool_or(valid).alias("is_valid"))


def with_usage(found: DataFrame, authorities: Authorities) -> DataFrame:
    """Add ``is_valid`` to rows with a ``tsn``; false where the TSN is not rated."""
    found = written(found, "found")
    # Rows without a TSN would all meet in one task of the join.
    coded = found.where(F.col("tsn").isNotNull())
    wanted = shuffled(coded.select("tsn").distinct())
    wanted = authorities.itis_units.join(wanted, "tsn", "left_semi")
    rated = coded.join(shuffled(_ratings(wanted)), "tsn", "left")
    rated = rated.withColumn("is_valid", F.coalesce("is_valid", F.lit(False)))
    return rated.unionByName(
        found.where(F.col("tsn").isNull()).withColumn("is_valid", F.lit(False))
    )


def with_accepted(found: DataFrame, authorities: Authorities) -> DataFrame:
    """Add ``accepted_tsn, accepted_name`` to rows with a ``tsn``, null if no synonym."""
    return found.join(authorities.itis_synonyms.distinct(), "tsn", "left")


def tsns_of(codes: DataFrame, authorities: Authorities) -> DataFrame:
    """All TSNs of each distinct AphiaID in ``code``; a null TSN where there is none."""
    links = authorities.xwalk.where(F.col("tsn").isNotNull()).distinct()
    return codes.join(shuffled(links), codes["code"] == links["aphia_id"], "left").select("code", "tsn")


def records_of(codes: DataFrame, authorities: Authorities) -> DataFrame:
    """All WoRMS records of each distinct TSN in ``code``; nulls where there is none."""
    links = authorities.links_by_tsn
    # Only links of the codes go on to their records.
    crossed = codes.join(shuffled(links), codes["code"] == links["tsn"]).select("code", "aphia_id").distinct()
    taxa = authorities.worms_taxa.select("aphia_id", "valid_aphia_id", "valid_name")
    found = crossed.join(shuffled(taxa), "aphia_id").select("code", *taxa.columns).distinct()
    return codes.join(shuffled(found), "code", "left")
