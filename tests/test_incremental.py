"""Runs over a store against whole runs, and the store itself."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from nomenlink import AnswerStore, resolve_incrementally, resolve_names
from nomenlink.plans import incremental
from nomenlink.sources.staging import shared_dir
from nomenlink.sources.store import VersionedTable

from test_policies import snapshots
from test_resolve import NAMES, random_world


def folder(spark):
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


def rows_of(frame):
    return sorted(map(str, frame.collect()))


def table(spark):
    return VersionedTable.create(spark, folder(spark), "k int, v string", ["k"])


def put(spark, store, rows, keys):
    frame = spark.createDataFrame(rows, "k int, v string")
    return store.upsert(frame, spark.createDataFrame([(k,) for k in keys], "k int"))


def test_a_key_has_the_rows_of_its_last_version(spark):
    store = table(spark)
    assert store.version() == 0 and store.read().collect() == []
    assert put(spark, store, [(1, "a"), (1, "b"), (2, "c")], [1, 2, 3]) == 1
    assert put(spark, store, [(1, "d"), (4, None)], [1, 2, 4]) == 2
    now = {(1, "d"), (4, None)}
    assert {tuple(r) for r in store.read().collect()} == now
    assert {r.k for r in store.known_keys().collect()} == {1, 2, 3, 4}
    assert store.compact() == 3
    assert {tuple(r) for r in store.read().collect()} == now
    assert {r.k for r in store.known_keys().collect()} == {1, 2, 3, 4}
    # Only the whole version is read from now on.
    assert len(store._lines()) == 1
    put(spark, store, [(2, "e")], [2, 4])
    assert {tuple(r) for r in store.read().collect()} == {(1, "d"), (2, "e")}
    with pytest.raises(Exception, match="(?i)exist"):
        VersionedTable.create(spark, store.folder, "k int, v string", ["k"])


def test_an_unfinished_version_is_not_read(spark, monkeypatch):
    store = table(spark)
    put(spark, store, [(1, "a")], [1])
    frame = spark.createDataFrame([(1, "b")], "k int, v string")
    with pytest.raises(Exception):
        store.upsert(frame.withColumn("v", F.raise_error(F.lit("stopped"))), frame)
    assert [tuple(r) for r in store.read().collect()] == [(1, "a")]
    assert put(spark, store, [(1, "c")], [1]) == 2
    assert [tuple(r) for r in store.read().collect()] == [(1, "c")]


def changed_world(world, seed, share):
    """The world with a share of the lines of every table gone, changed or new."""
    chance = random.Random(seed)
    other, _ = random_world(seed + 100)
    out = {}
    for name, lines in world.items():
        new = [x for x in lines if chance.random() > share]
        if name in ("worms_taxa", "itis_units", "itis_synonyms"):
            # Keyed by their first column.
            taken = {x[0] for x in new}
            new += [x for x in other[name] if x[0] not in taken and (name != "itis_units" or x[0] in {y[0] for y in lines})]
            ids = {x[0] for x in new}
            new += [x for x in lines if x[0] not in ids]
        else:
            new += [x for x in other[name] if chance.random() < share]
        out[name] = new
    ids = {x[0] for x in out["worms_taxa"]}
    out["worms_vernacular"] = [x for x in out["worms_vernacular"] if x[0] in ids]
    return out


@pytest.mark.parametrize("seed, share", [(21, 0.2)])
def test_runs_over_a_store_equal_whole_runs(spark, seed, share):
    world, rows = random_world(seed)
    later = changed_world(world, seed, share)
    assert later != world
    store = AnswerStore.create(spark, folder(spark))
    first = spark.createDataFrame(rows[:100], NAMES)
    every = spark.createDataFrame(rows, NAMES)
    for frame, lines in ((first, world), (every, later)):
        known = snapshots(spark, **lines).staged()
        ours = resolve_incrementally(frame, known, store, "sci", "comm")
        whole = resolve_names(frame, known, "sci", "comm")
        assert rows_of(ours.resolved) == rows_of(whole.resolved)
        assert rows_of(ours.ambiguous) == rows_of(whole.ambiguous)


def test_only_new_and_touched_names_are_searched(spark, monkeypatch):
    names = [f"NAME{i} X" for i in range(200)]
    taxa = [(i, n, "accepted", i, n) for i, n in enumerate(names)]
    world = {"worms_taxa": taxa, "itis_names": [(1000 + i, n) for i, n in enumerate(names)],
             "itis_units": [(1000 + i, "valid") for i in range(200)],
             "xwalk": [(i, 1000 + i) for i in range(200)]}
    rows = [(i, n, None) for i, n in enumerate(names)]
    searched, sent = [], []
    search, cross = incremental.search_names, incremental.cross_codes
    monkeypatch.setattr(incremental, "search_names", lambda n, a: searched.append(n.count()) or search(n, a))
    monkeypatch.setattr(incremental, "cross_codes", lambda c, a: sent.append(c.count()) or cross(c, a))
    store = AnswerStore.create(spark, folder(spark))

    def run(rows, world):
        known = snapshots(spark, **world)
        frame = spark.createDataFrame(rows, NAMES)
        ours = resolve_incrementally(frame, known, store, "sci", "comm", only="resolved").resolved
        if len(searched) == 3:
            whole = resolve_names(frame, known, "sci", "comm", only="resolved").resolved
            assert rows_of(ours) == rows_of(whole)

    run(rows[:198], world)
    run(rows[:198], world)
    # One percent of new names, and of changed records.
    world["worms_taxa"] = [(i, n, s, 150 if i == 7 else v, m) for i, n, s, v, m in taxa]
    world["xwalk"] = [x for x in world["xwalk"] if x[0] != 9] + [(11, 1050)]
    run(rows, world)
    assert searched == [198, 0, 3]
    # Of the AphiaIDs and TSNs, those of two new names, and those the changes touch.
    assert sent[0] == 396 and sent[1] == 0 and 4 <= sent[2] <= 12
    # A store that is compacted knows the same.
    store.compact()
    run(rows, world)
    assert searched[-1] == 0 and sent[-1] == 0


def test_a_tsn_added_later_is_found(spark):
    taxa = [(1, "Alba", "accepted", 1, "Alba")]
    units = {"itis_names": [(101, "Other")], "itis_units": [(101, "valid")]}
    rows = spark.createDataFrame([(1, "Alba", None)], NAMES)
    store = AnswerStore.create(spark, folder(spark))
    for links, want in (([], None), ([(1, 101)], 101), ([], None)):
        known = snapshots(spark, worms_taxa=taxa, xwalk=links, **units)
        got = resolve_incrementally(rows, known, store, "sci", "comm").resolved.first()
        assert (got["aphiaid"], got["tsn"]) == (1, want)


def test_derived_best_matches(spark):
    def known(taxa):
        whole = snapshots(spark, worms_taxa=taxa)
        return type(whole)(**{f: getattr(whole, f) for f in whole.__dataclass_fields__ if f != "worms_best_match"})

    rows = spark.createDataFrame([(1, "GADUS", None), (2, "GADUS MORHUA", None), (3, "SOLEA", None)], NAMES)
    store = AnswerStore.create(spark, folder(spark))
    one = [(5, "Gadus morhua", "accepted", 5, "Gadus morhua")]
    for taxa in (one, one + [(2, "Gadus ogac", "accepted", 2, "Gadus ogac")]):
        ours = resolve_incrementally(rows, known(taxa), store, "sci", "comm")
        whole = resolve_names(rows, known(taxa), "sci", "comm")
        assert rows_of(ours.resolved) == rows_of(whole.resolved)


def test_empty_input_and_missing_names(spark):
    store = AnswerStore.create(spark, folder(spark))
    known = snapshots(spark)
    assert resolve_incrementally(spark.createDataFrame([], NAMES), known, store, "sci", "comm").resolved.count() == 0
    rows = spark.createDataFrame([(1, None, None), (2, "", None)], NAMES)
    assert resolve_incrementally(rows, known, store, "sci", "comm").resolved.count() == 2
