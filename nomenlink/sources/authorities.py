"""Snapshots of the taxonomic authorities, in fixed schemas.

Each snapshot replaces one remote lookup, so that a lookup is a join. Names are put
into canonical form and codes cast to ``bigint`` once, on the way in; a code that is
not a number becomes null instead of failing the job.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import canonical
from .staging import stage

# Table -> (code columns, name columns, other columns).
_TABLES = {
    "worms_taxa": (
        ("aphia_id", "valid_aphia_id"), ("scientificname", "valid_name"), ("status",)
    ),
    "worms_vernacular": (("aphia_id",), ("vernacular",), ()),
    "worms_best_match": (
        ("aphia_id",), ("query",), ("multiple_matches", "pattern_match")
    ),
    "itis_names": (("tsn",), ("combined_name",), ()),
    "itis_vernacular": (("tsn",), ("common_name",), ()),
    "itis_units": (("tsn",), (), ("usage_rating",)),
    "itis_synonyms": (("tsn", "accepted_tsn"), ("accepted_name",), ()),
    "xwalk": (("aphia_id", "tsn"), (), ()),
}


@dataclass(frozen=True)
class Authorities:
    """The eight snapshot tables. ``aphia_id`` is unique in ``worms_taxa``.

    Without ``worms_best_match`` the best match is derived from the taxa and the
    vernacular names.
    """

    worms_taxa: DataFrame
    worms_vernacular: DataFrame
    itis_names: DataFrame
    itis_vernacular: DataFrame
    itis_units: DataFrame
    itis_synonyms: DataFrame
    xwalk: DataFrame
    worms_best_match: DataFrame | None = None

    def __post_init__(self) -> None:
        for field in fields(self):
            table = getattr(self, field.name)
            if table is not None:
                object.__setattr__(self, field.name, _ingest(field.name, table))

    @classmethod
    def read(cls, spark: SparkSession, folder: str, best_match: bool = True) -> Authorities:
        """Read one parquet table per snapshot from a folder."""
        names = [n for n in _TABLES if best_match or n != "worms_best_match"]
        return cls(**{n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names})

    @property
    def taxa_by_name(self) -> DataFrame:
        """The taxa, in the order for a search by scientific name if there is one."""
        return self.worms_taxa

    @property
    def links_by_tsn(self) -> DataFrame:
        """The crosswalk, in the order for a search by TSN if there is one."""
        return self.xwalk

    def staged(self) -> Authorities:
        """The same snapshots, written once: for authorities that are costly to derive."""
        tables = {f.name: getattr(self, f.name) for f in fields(self)}
        return replace(
            self,
            **{n: stage(t, n).frame for n, t in tables.items() if t is not None},
        )


def _ingest(name: str, table: DataFrame) -> DataFrame:
    codes, names, others = _TABLES[name]
    missing = [c for c in (*codes, *names, *others) if c not in table.columns]
    if missing:
        raise ValueError(f"{name} lacks the columns {missing}")
    return table.select(
        *(F.col(c).try_cast("bigint").alias(c) for c in codes),
        *(canonical(F.col(c)).alias(c) for c in names),
        *others,
    )
