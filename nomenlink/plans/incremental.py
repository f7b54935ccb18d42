"""Runs that resolve only what is new: names, and records that changed since the last run.

A store keeps what earlier runs found, by what it depends on: the decided candidates of a
name, the crosswalk's answers to a code, and the chosen candidates of a pair of names, with
the snapshots they come from. A run compares its snapshots with those. A changed line finds
the names whose search could have met it and the codes whose crosswalk could have passed it,
from the lines of both snapshots. Only these and the new names are searched, only these and
the new codes are sent, and only pairs with such a name or code are decided again.

Every part of the store is written before the snapshots of the run are noted. So a run that
ends early leaves nothing that the next one would take for settled: it finds the same changes
again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import eligible
from ..operators.assemble import LISTED, Resolved, check_names_free
from ..operators.joins import BROADCAST_BYTES
from ..operators.policies import APHIAID, CODE_COLUMNS, TSN
from ..operators.prefixes import prefix_matches
from ..sources.authorities import Authorities
from ..sources.names import check_columns
from ..sources.prepared import PreparedAuthorities
from ..sources.staging import shuffled, stage, written
from ..sources.store import VersionedTable
from .resolve import (
    choose,
    codes_to_send,
    cross_codes,
    names_of,
    put_together,
    search_names,
    stage_pairs,
)

_CODES = (
    "code bigint, code_svc string, code_type string, code_definitive boolean, "
    "code_src string, sugg_spelling string"
)
_TABLES = {
    "decided": (f"name string, {_CODES}, several boolean, rank int", ("name", "code_src")),
    "links": (f"sent bigint, {_CODES}", ("sent", "code_type")),
    "answers": (f"sci_key string, comm_key string, {_CODES}", ("sci_key", "comm_key")),
    "snapshots": ("name string, folder string", ("name",)),
}
# No cleaned name is empty, so this stands for a missing one.
_MISSING = ""
_PAIR = ("sci_key", "comm_key")


@dataclass(frozen=True)
class AnswerStore:
    """What earlier runs found, as versioned tables under one shared folder."""

    folder: str
    decided: VersionedTable
    links: VersionedTable
    answers: VersionedTable
    snapshots: VersionedTable

    @classmethod
    def create(cls, spark: SparkSession, folder: str) -> AnswerStore:
        """An empty store; an error if there is one already."""
        made = {
            n: VersionedTable.create(spark, f"{folder}/{n}", schema, keys)
            for n, (schema, keys) in _TABLES.items()
        }
        return cls(folder, **made)

    def snapshot(self) -> Authorities | None:
        """The snapshots of the last whole run."""
        held = {r["name"]: r["folder"] for r in self.snapshots.read().collect()}
        if not held:
            return None
        spark = self.snapshots.spark
        return Authorities(**{n: spark.read.parquet(f) for n, f in held.items()})

    def keep(self, authorities: Authorities) -> dict[str, str]:
        """Write the snapshots beside the store, and give the folder of each."""
        base = f"{self.folder}/snapshot-{uuid.uuid4().hex}"
        folders = {}
        for field in fields(Authorities):
            table = getattr(authorities, field.name)
            if table is not None:
                folders[field.name] = f"{base}/{field.name}"
                table.write.parquet(folders[field.name])
        return folders

    def note(self, folders: dict[str, str]) -> None:
        """Say that everything in the store now agrees with the snapshots kept there."""
        spark, names = self.snapshots.spark, [f.name for f in fields(Authorities)]
        rows = spark.createDataFrame(list(folders.items()), _TABLES["snapshots"][0])
        self.snapshots.upsert(rows, spark.createDataFrame([(n,) for n in names], "name string"))

    def compact(self) -> None:
        for table in (self.decided, self.links, self.answers):
            table.compact()


class _Changes:
    """What differs between two snapshots, and what either of them says."""

    def __init__(self, old: Authorities, new: Authorities):
        self.old, self.new = old, new
        self._lines: dict[str, DataFrame] = {}

    def both(self, name: str) -> DataFrame:
        return getattr(self.old, name).unionByName(getattr(self.new, name))

    def lines(self, name: str) -> DataFrame:
        """The lines that only one of them has, written once; repeated lines say nothing."""
        if name not in self._lines:
            old, new = getattr(self.old, name), getattr(self.new, name)
            # One aggregate over both tells which of them has a line; null equals null.
            sides = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
            sides = sides.groupBy(*old.columns).agg(
                F.min("_side").alias("_first"), F.max("_side").alias("_last")
            )
            found = sides.where(F.col("_first") == F.col("_last")).select(*old.columns)
            self._lines[name] = written(found, f"changed_{name}")
        return self._lines[name]

    def ids(self, key: str, *names: str) -> DataFrame:
        parts = [self.lines(n).select(key) for n in names]
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        return found.where(F.col(key).isNotNull()).distinct()


def _texts(kind: str, frame: DataFrame, column: str) -> DataFrame:
    return frame.select(F.lit(kind).alias("kind"), F.col(column).alias("text"))


def _union(frames: list[DataFrame]) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first.where(F.col("text").isNotNull()).distinct()


def touched_names(found: _Changes, known: DataFrame) -> DataFrame:
    """The ``kind, name`` rows of ``known`` whose search could have met a changed line."""
    old, new = found.old, found.new
    if (old.worms_best_match is None) != (new.worms_best_match is None):
        return known
    records = written(found.ids("aphia_id", "worms_taxa"), "changed_records")
    units = written(found.ids("tsn", "itis_units", "itis_synonyms"), "changed_units")

    def of_records(name: str) -> DataFrame:
        return found.both(name).join(shuffled(records), "aphia_id", "left_semi")

    def of_units(name: str) -> DataFrame:
        return found.both(name).join(shuffled(units), "tsn", "left_semi")

    whole = [
        _texts("scientific", found.lines("worms_taxa"), "scientificname"),
        _texts("common", found.lines("worms_vernacular"), "vernacular"),
        _texts("common", of_records("worms_vernacular"), "vernacular"),
    ]
    parts = []
    if old.worms_best_match is None:
        # The best match is derived, from all names that the searched one begins.
        parts.append(prefix_matches(known, written(_union(whole), "changed_texts"), ["kind"]))
    else:
        for kind in ("scientific", "common"):
            whole.append(_texts(kind, found.lines("worms_best_match"), "query"))
            whole.append(_texts(kind, of_records("worms_best_match"), "query"))
    leading = _union(
        [
            _texts("scientific", found.lines("itis_names"), "combined_name"),
            _texts("scientific", of_units("itis_names"), "combined_name"),
            _texts("common", found.lines("itis_vernacular"), "common_name"),
            _texts("common", of_units("itis_vernacular"), "common_name"),
        ]
    )
    parts.append(prefix_matches(known, written(leading, "changed_units"), ["kind"], whole_words=True))
    equal = shuffled(_union(whole).withColumnRenamed("text", "name"))
    parts.append(known.join(equal, ["kind", "name"], "left_semi"))
    names = parts[0].select("kind", "name")
    for part in parts[1:]:
        names = names.unionByName(part.select("kind", "name"))
    return names.distinct()


def touched_codes(found: _Changes) -> DataFrame:
    """The ``code_type, code`` whose crosswalk could have passed a changed line."""
    crossed, links = found.lines("xwalk"), found.both("xwalk")
    rated, records = found.ids("tsn", "itis_units"), found.ids("aphia_id", "worms_taxa")
    to_tsn = crossed.select("aphia_id").unionByName(
        links.join(shuffled(rated), "tsn", "left_semi").select("aphia_id")
    )
    to_aphia = crossed.select("tsn").unionByName(
        links.join(shuffled(records), "aphia_id", "left_semi").select("tsn")
    )
    codes = to_tsn.select(F.lit(APHIAID).alias("code_type"), F.col("aphia_id").alias("code"))
    codes = codes.unionByName(
        to_aphia.select(F.lit(TSN).alias("code_type"), F.col("tsn").alias("code"))
    )
    return codes.where(F.col("code").isNotNull()).distinct()


def _other(code_type: str):
    return F.when(F.col(code_type) == TSN, APHIAID).otherwise(TSN)


def resolve_incrementally(
    names: DataFrame,
    authorities: Authorities,
    store: AnswerStore,
    sci_col: str | None = None,
    comm_col: str | None = None,
    sci_filters: Sequence[str] = (),
    comm_filters: Sequence[str] = (),
    debug: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    only: str | None = None,
    listed: int = LISTED,
) -> Resolved:
    """As ``resolve_names``, taking from the store what it still knows, and adding to it.

    ``links`` of the result are the crosswalk answers of the whole store. The store must
    have no other writer meanwhile.
    """
    check_columns(names, sci_col, comm_col)
    check_names_free(names)
    if only not in (None, "resolved", "ambiguous"):
        raise ValueError(f"no such result: {only!r}")
    pairs = stage_pairs(names, sci_col, comm_col, sci_filters, comm_filters)
    sci_key, comm_key = (
        F.coalesce(c, F.lit(_MISSING)).alias(k) for c, k in zip(("sci_clean", "comm_clean"), _PAIR)
    )
    keyed = pairs.frame.where(eligible(F.col("sci_clean"), F.col("comm_clean")))
    keyed = keyed.select("id", sci_key, comm_key)
    _update(store, keyed.select(*_PAIR).distinct(), authorities, broadcast_bytes)

    cands = keyed.join(shuffled(store.answers.read()), list(_PAIR)).select("id", *CODE_COLUMNS)
    columns = {"sci_raw": sci_col, "comm_raw": comm_col}
    result = put_together(names, pairs, cands, columns, debug, broadcast_bytes, only, listed)
    return result._replace(links=store.links.read())


def _update(
    store: AnswerStore, asked: DataFrame, authorities: Authorities, broadcast_bytes: int
) -> None:
    """Bring the store up to the snapshots, and let it know the asked pairs."""
    before = store.snapshot()
    kept = store.keep(authorities)
    if not isinstance(authorities, PreparedAuthorities):
        # The run reads the snapshots that it keeps, so what gives them runs once.
        read = store.snapshots.spark.read
        authorities = Authorities(**{n: read.parquet(f) for n, f in kept.items()})
    changes = None if before is None else _Changes(before, authorities)
    known = store.decided.known_keys().withColumnRenamed("code_src", "kind")
    asked = written(asked, "asked")
    null = lambda c: F.when(F.col(c) != _MISSING, F.col(c))

    def cleaned(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"sci_clean": null("sci_key"), "comm_clean": null("comm_key")})

    # Names: those never searched, and those that a changed line touches.
    to_search = names_of(cleaned(asked)).join(shuffled(known), ["kind", "name"], "left_anti")
    if changes is not None:
        to_search = to_search.unionByName(touched_names(changes, known))
    to_search = written(to_search.select("kind", "name"), "to_search")
    decided = search_names(to_search, authorities)
    store.decided.upsert(decided, to_search.withColumnRenamed("kind", "code_src"))
    decided = store.decided.read()

    # Codes: those that a candidate has and nobody sent, and those that a change touches.
    answered = store.links.known_keys().select(_other("code_type").alias("code_type"), F.col("sent").alias("code"))
    coded = decided.select("code_type", "code", "name", F.col("code_src").alias("kind"))
    to_send = codes_to_send(decided).join(shuffled(answered), ["code_type", "code"], "left_anti")
    changed = to_send.limit(0)
    if changes is not None:
        changed = written(
            answered.join(shuffled(touched_codes(changes)), ["code_type", "code"], "left_semi"),
            "changed_codes",
        )
    to_send = written(to_send.unionByName(changed), "to_send")
    sent = to_send.select(_other("code_type").alias("code_type"), F.col("code").alias("sent"))
    store.links.upsert(cross_codes(to_send, authorities), sent)

    # Pairs: new ones, and those with such a name or a name with such a code.
    again = coded.join(shuffled(changed), ["code_type", "code"], "left_semi").select("kind", "name")
    again = written(again.unionByName(to_search).distinct(), "names_again")
    held = store.answers.known_keys()
    by_name = [
        held.join(
            shuffled(again.where(F.col("kind") == kind).select(F.col("name").alias(key))), key, "left_semi"
        )
        for kind, key in zip(("scientific", "common"), _PAIR)
    ]
    fresh = asked.join(shuffled(held), list(_PAIR), "left_anti")
    todo = fresh.unionByName(by_name[0]).unionByName(by_name[1]).distinct()
    todo = written(todo.withColumn("id", F.monotonically_increasing_id()), "pairs_again")

    wanted = names_of(cleaned(todo)).withColumnRenamed("kind", "code_src")
    decided = stage(decided.join(shuffled(wanted), ["name", "code_src"], "left_semi"), "decided")
    codes = decided.frame.where(F.col("code").isNotNull()).select(
        _other("code_type").alias("code_type"), F.col("code").alias("sent")
    )
    links = stage(store.links.read().join(shuffled(codes.distinct()), ["sent", "code_type"], "left_semi"), "links")
    chosen = choose(cleaned(todo).select("id", "sci_clean", "comm_clean"), decided, links, broadcast_bytes)
    rows = todo.join(shuffled(chosen), "id").drop("id")
    store.answers.upsert(rows, todo)
    store.note(kept)
