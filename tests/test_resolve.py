"""The whole resolution against a naive one, row by row and pass by pass."""

import random

import pytest
from nomenlink import Authorities, resolve_names, sent_codes
from nomenlink.sources.staging import shared_dir, stage

from test_policies import SCHEMAS, snapshots

WORDS = ["GADU", "ALBA", "NOVA", "MINO", "RUBRA"]


def random_world(seed):
    """Small snapshots in which every kind of collision is likely."""
    chance = random.Random(seed)

    def name():
        return " ".join(chance.choice(WORDS) for _ in range(chance.choice([1, 1, 2, 2, 3])))

    def maybe(value, odds=0.2):
        return None if chance.random() < odds else value

    ids, tsns = range(1, 41), range(101, 141)
    world = {
        "worms_taxa": [
            (i, name(), chance.choice(["accepted", "unaccepted", None]),
             maybe(chance.choice(ids)), maybe(name()))
            for i in ids
        ],
        "worms_vernacular": [(chance.choice(ids), name()) for _ in range(40)],
        "worms_best_match": [
            (name(), chance.choice(list(ids) + [999]), maybe(chance.random() < 0.5),
             maybe(chance.random() < 0.5))
            for _ in range(25)
        ],
        "itis_names": [(chance.choice(tsns), name()) for _ in range(40)],
        "itis_vernacular": [(chance.choice(tsns), name()) for _ in range(40)],
        "itis_units": [(t, chance.choice(["valid", "invalid", None])) for t in tsns if t % 5],
        "itis_synonyms": [
            (t, maybe(chance.choice(tsns)), maybe(name())) for t in tsns if t % 3 == 0
        ],
        "xwalk": [(chance.choice(ids), chance.choice(tsns)) for _ in range(45)],
    }
    rows = [(i, maybe(name(), 0.25), maybe(name(), 0.25)) for i in range(150)]
    return world, rows


class Naive:
    """One row at a time, one pass after the other."""

    def __init__(self, world):
        self.w = world
        self.taxa = {t[0]: t for t in world["worms_taxa"]}
        self.rating = {t for t, r in world["itis_units"] if r == "valid"}

    def best(self, name, kind):
        hits = [b for b in self.w["worms_best_match"] if b[0] == name]
        if not hits:
            return []
        hit = min(hits, key=lambda b: (b[3] is not False, b[1]))
        taxon = self.taxa.get(hit[1])
        if not taxon or taxon[3] is None or taxon[4] is None:
            return []
        return [(taxon[3], "TAXIZE & WORRMS", hit[3] is False, kind, taxon[4])]

    def worms(self, name, kind, sci=None):
        if kind == "scientific":
            hits = [t for t in self.w["worms_taxa"] if t[1] == name]
        else:
            ids = {i for i, v in self.w["worms_vernacular"] if v == name}
            hits = [self.taxa[i] for i in sorted(ids)]
        coded = [t for t in hits if t[3] is not None]
        if len(coded) == 1:
            hits = coded
        if len(hits) == 1:
            sure = [hits[0][3] is not None]
        else:
            accepted = [t for t in hits if t[2] == "accepted"]
            several, hits = len(hits) > 1, accepted or hits
            sure = [len(accepted) == 1 and t[3] is not None for t in hits]
            if several and kind == "common" and sci is not None:
                same = [t for t in hits if t[4] == sci]
                if len(same) == 1:
                    hits, sure = same, [same[0][3] is not None]
                elif same:
                    sure = [s for t, s in zip(hits, sure) if t[4] == sci]
                    hits = same
        return [
            (t[3], "WORRMS", s, kind, t[4]) for t, s in zip(hits, sure) if t[3] is not None
        ]

    def itis(self, name, kind):
        table = self.w["itis_names" if kind == "scientific" else "itis_vernacular"]
        hits = {h for h in table if h[1] == name or h[1].startswith(name + " ")}
        hits = [h for h in hits if len(h[1].split(" ")) == len(name.split(" "))] or list(hits)
        hits = [h for h in hits if h[0] in self.rating] or hits
        units = []
        for tsn, spelling in hits:
            # A synonym entry without an accepted code says nothing.
            accepted = [s for s in self.w["itis_synonyms"] if s[0] == tsn and s[1] is not None]
            units += [(a[1], a[2]) for a in accepted] or [(tsn, spelling)]
        if len(units) == 1:
            sure = True
        else:
            same = [u for u in units if u[1] == name]
            sure = len(same) == 1
            units = same if sure else units
        return [(c, "RITIS", sure, kind, s) for c, s in set(units)]

    def to_tsn(self, code):
        tsns = {t for a, t in self.w["xwalk"] if a == code}
        return [(t, "WORRMS", t in self.rating, "APHIAID", None) for t in tsns]

    def to_aphia(self, code):
        found = [self.taxa[a] for a in {a for a, t in self.w["xwalk"] if t == code}]
        return [
            (t[3] if t[3] is not None else t[0], "WORRMS",
             t[3] is not None and len(found) == 1, "TSN", t[4] if t[3] is not None else None)
            for t in found
        ]

    def row(self, sci, comm):
        if sci and comm:
            # A common name less the row's own scientific name.
            comm = " ".join(comm.replace(sci, "").split()) or None
        state = {"APHIAID": ([], []), "TSN": ([], [])}  # definitive, doubtful

        def answer(kind, found):
            sure = {f for f in found if f[2]}
            if sure:
                state[kind] = (sorted(sure, key=repr), [])
            elif found:
                state[kind] = ([], sorted(set(found), key=repr))

        for name, kind in ((sci, "scientific"), (comm, "common")):
            if name is None:
                continue
            if not state["APHIAID"][0]:
                answer("APHIAID", self.best(name, kind))
                if not state["APHIAID"][0]:
                    answer("APHIAID", self.worms(name, kind, sci))
                if state["APHIAID"][0] and not state["TSN"][0]:
                    answer("TSN", [x for f in state["APHIAID"][0] for x in self.to_tsn(f[0])])
            if not state["TSN"][0]:
                answer("TSN", self.itis(name, kind))
                if state["TSN"][0] and not state["APHIAID"][0]:
                    answer("APHIAID", [x for f in state["TSN"][0] for x in self.to_aphia(f[0])])
        return {k: self.review(d or m, sci, comm) for k, (d, m) in state.items()}

    @staticmethod
    def review(found, sci, comm):
        seen = {(c, v, d, s, None if g in (sci, comm) else g) for c, v, d, s, g in found}
        exact = {f for f in seen if f[2] or f[4] is None}
        return exact or seen


def as_sets(result):
    """Per input row, all candidates of both types, from the two result tables."""
    wide = {r["key"]: r for r in result.resolved.collect()}
    got = {k: {"APHIAID": set(), "TSN": set()} for k in wide}
    for key, r in wide.items():
        for kind in ("APHIAID", "TSN"):
            p = kind.lower()
            if r[p] is not None:
                got[key][kind].add(
                    (r[p], r[p + "_svc"], r[p + "_definitive"], r[p + "_src"], r[p + "_spelling"])
                )
            else:
                assert r[p + "_svc"] is None and r[p + "_definitive"] is None
    for r in result.ambiguous.collect():
        assert wide[r["key"]][r["code_type"].lower()] is None
        assert wide[r["key"]][r["code_type"].lower() + "_multi_flag"] is True
        got[r["key"]][r["code_type"]].add(
            (r["code_sugg"], r["code_svc"], r["code_definitive"], r["code_src"], r["sugg_spelling"])
        )
    for key, r in wide.items():
        for kind in ("APHIAID", "TSN"):
            assert r[kind.lower() + "_multi_flag"] == (len(got[key][kind]) > 1)
    return got


NAMES = "key int, sci string, comm string"


@pytest.mark.parametrize("seed, limit", [(1, 1 << 20), (2, 0), (3, 1 << 20), (4, 600)])
def test_against_the_naive_passes(spark, seed, limit):
    world, rows = random_world(seed)
    result = resolve_names(
        spark.createDataFrame(rows, NAMES), snapshots(spark, **world), "sci", "comm",
        broadcast_bytes=limit,
    )
    naive = Naive(world)
    got = as_sets(result)
    assert len(got) == len(rows)
    wrong = {k: (s, c, got[k], naive.row(s, c)) for k, s, c in rows if got[k] != naive.row(s, c)}
    assert wrong == {}
    answered = sum(bool(g["APHIAID"]) + bool(g["TSN"]) for g in got.values())
    assert answered > 100


def without_crosswalk(spark, world):
    """Snapshots in which no code leads anywhere."""
    return snapshots(spark, **{**world, "xwalk": []})


def test_a_second_run_takes_the_answers_of_the_first_one(spark):
    world, rows = random_world(10)
    half, known = rows[::2], snapshots(spark, **world)
    first = resolve_names(spark.createDataFrame(half, NAMES), known, "sci", "comm")
    assert {r["code_type"] for r in first.links.select("code_type").distinct().collect()} == {"APHIAID", "TSN"}
    # Codes that the first run sent get their answers although the crosswalk has gone.
    again = resolve_names(
        spark.createDataFrame(half, NAMES), without_crosswalk(spark, world), "sci", "comm",
        checked=first.links,
    )
    assert as_sets(again) == as_sets(first)
    # New codes are looked up, and all rows come out as in a run from scratch.
    whole = resolve_names(
        spark.createDataFrame(rows, NAMES), known, "sci", "comm", checked=first.links
    )
    naive = Naive(world)
    got = as_sets(whole)
    assert {k: got[k] for k, _, _ in rows} == {k: naive.row(s, c) for k, s, c in rows}
    before = {tuple(r) for r in first.links.collect()}
    assert before < {tuple(r) for r in whole.links.collect()}


def test_sent_codes_of_one_row(spark):
    """The TSN of a scientific name went out, though the common name gave the AphiaID."""
    taxa = [(3, "Alba nova", "accepted", 3, "Alba nova")]
    known = snapshots(
        spark, worms_taxa=taxa, worms_vernacular=[(3, "Whitefish")],
        itis_names=[(101, "Gadu mino")], itis_units=[(101, "valid")],
    )
    rows = spark.createDataFrame([(1, "Gadu mino", "Whitefish")], NAMES)
    result = resolve_names(rows, known, "sci", "comm")
    got = result.resolved.first()
    assert (got["aphiaid"], got["aphiaid_src"], got["tsn"], got["tsn_src"]) == (3, "common", 101, "scientific")
    assert [tuple(r) for r in sent_codes(result.resolved).collect()] == [("TSN", 101)]


def test_a_tsn_with_several_records_leaves_the_aphiaid_to_the_common_name(spark):
    taxa = [(i, n, "accepted", i, n) for i, n in ((1, "Alba"), (2, "Nova"), (3, "Rubra"))]
    known = snapshots(
        spark, worms_taxa=taxa, worms_vernacular=[(3, "Whitefish")], xwalk=[(1, 101), (2, 101)],
        itis_names=[(101, "Gadu mino")], itis_units=[(101, "valid")],
    )
    rows = spark.createDataFrame([(1, "Gadu mino", "Whitefish"), (2, "Gadu mino", None)], NAMES)
    got = as_sets(resolve_names(rows, known, "sci", "comm"))
    assert got[1]["APHIAID"] == {(3, "WORRMS", True, "common", "RUBRA")}
    assert got[2]["APHIAID"] == {(i, "WORRMS", False, "TSN", n) for i, n in ((1, "ALBA"), (2, "NOVA"))}


def test_repeated_snapshot_lines_change_nothing(spark):
    world, rows = random_world(11)
    twice = {n: lines * 2 for n, lines in world.items()}
    df = spark.createDataFrame(rows, NAMES)
    one, two = (as_sets(resolve_names(df, snapshots(spark, **w), "sci", "comm")) for w in (world, twice))
    assert one == two


@pytest.mark.parametrize("column", ["sci", "comm"])
def test_one_column_alone(spark, column):
    world, rows = random_world(6)
    df = spark.createDataFrame(rows, NAMES)
    result = resolve_names(df, snapshots(spark, **world), **{f"{column}_col": column})
    naive = Naive(world)
    got = as_sets(result)
    for key, sci, comm in rows:
        want = naive.row(sci, None) if column == "sci" else naive.row(None, comm)
        assert got[key] == want


def test_result_does_not_depend_on_partitions(spark):
    world, rows = random_world(7)
    known = snapshots(spark, **world)
    df = spark.createDataFrame(rows, NAMES)
    one = as_sets(resolve_names(df.coalesce(1), known, "sci", "comm"))
    many = as_sets(resolve_names(df.repartition(8), known, "sci", "comm"))
    assert one == many


def test_a_third_of_the_rows_with_one_name(spark):
    """Copies of a row, rows without names and distinct rows, by every way of joining."""
    world, rows = random_world(8)
    key, sci, comm = next(r for r in rows if all(r))
    many = [(key, sci, comm)] * 300 + [(key, None, None)] * 300 + rows
    df = spark.createDataFrame(
        [(i, s, c) for i, (_, s, c) in enumerate(many)], NAMES
    )
    known = snapshots(spark, **world)
    naive = Naive(world)
    want = {i: naive.row(s, c) for i, (_, s, c) in enumerate(many)}
    for limit in (1 << 20, 600, 0):
        assert as_sets(resolve_names(df, known, "sci", "comm", broadcast_bytes=limit)) == want


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_the_input_is_read_twice_for_both_results(spark, limit):
    world, rows = random_world(12)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, NAMES)
    known = snapshots(spark, **world).staged()
    result = resolve_names(
        df.mapInArrow(counted, df.schema), known, "sci", "comm", broadcast_bytes=limit
    )
    assert result.resolved.count() == len(rows)
    assert result.ambiguous.select("sugg_spelling").collect()
    assert read.value == 2 * len(rows)
    for only, other in (("resolved", "ambiguous"), ("ambiguous", "resolved")):
        alone = resolve_names(df, known, "sci", "comm", broadcast_bytes=limit, only=only)
        assert getattr(alone, other) is None
        a, b = (sorted(map(str, getattr(r, only).collect())) for r in (alone, result))
        assert a == b


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_long_lists_of_candidates_are_joined_instead(spark, limit):
    """Whatever number of candidates an answer may list, the report is the same."""
    units = [(i, f"GADU {w}") for i, w in enumerate("ABCDEFGHIJKL")]
    known = snapshots(spark, itis_names=units + [(50, "ALBA A"), (51, "ALBA B")])
    rows = [(i, ("GADU", "ALBA", None)[i % 3], None) for i in range(60)]
    df = spark.createDataFrame(rows, NAMES)
    found = [
        resolve_names(df, known, "sci", "comm", broadcast_bytes=limit, listed=n) for n in (1, 5, 1000)
    ]
    reports = [sorted(map(str, f.ambiguous.collect())) for f in found]
    assert len(reports[0]) == 20 * 12 + 20 * 2
    assert reports[0] == reports[1] == reports[2]
    wide = [sorted(map(str, f.resolved.collect())) for f in found]
    assert len(wide[0]) == 60 and wide[0] == wide[1] == wide[2]


def test_every_input_row_comes_out_once_with_its_own_columns(spark):
    world, rows = random_world(9)
    df = spark.createDataFrame(rows + rows, NAMES)
    result = resolve_names(df, snapshots(spark, **world), "sci", "comm")
    assert result.resolved.count() == 2 * len(rows)
    back = result.resolved.select("key", "sci", "comm")
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0
    flags = result.resolved.select("aphiaid_multi_flag", "tsn_multi_flag")
    assert flags.where("aphiaid_multi_flag IS NULL OR tsn_multi_flag IS NULL").count() == 0


def test_dirty_names_meet_clean_ones(spark):
    taxa = [(1, "Gadus morhua", "accepted", 1, "Gadus morhua")]
    known = snapshots(spark, worms_taxa=taxa, worms_vernacular=[(1, "Atlantic cod")])
    rows = [
        (1, "gadus  morhua (L.)", None), (2, None, "COD, ATLANTIC"), (3, "gadus morhua", "gadus morhua roe"),
        (4, "UNIDENTIFIED SPECIES", "cod eggs"), (5, "", ""),
    ]
    wide = resolve_names(spark.createDataFrame(rows, NAMES), known, "sci", "comm").resolved
    got = {r["key"]: (r["aphiaid"], r["aphiaid_src"], r["aphiaid_spelling"]) for r in wide.collect()}
    assert got == {
        1: (1, "scientific", None), 2: (1, "common", "GADUS MORHUA"), 3: (1, "scientific", None),
        4: (None, None, None), 5: (None, None, None),
    }


def test_best_match_is_derived_without_a_snapshot(spark):
    tables = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items() if n != "worms_best_match"}
    tables["worms_taxa"] = spark.createDataFrame(
        [(1, "Gadus morhua", "accepted", 1, "Gadus morhua")], SCHEMAS["worms_taxa"]
    )
    rows = spark.createDataFrame([(1, "GADUS", None), (2, "GADUS MORHUA", None)], NAMES)
    wide = resolve_names(rows, Authorities(**tables), "sci", "comm").resolved.orderBy("key")
    got = [(r["aphiaid"], r["aphiaid_definitive"], r["aphiaid_spelling"]) for r in wide.collect()]
    assert got == [(1, False, "GADUS MORHUA"), (1, True, None)]


def test_empty_input(spark):
    result = resolve_names(spark.createDataFrame([], NAMES), snapshots(spark), "sci", "comm")
    assert (result.resolved.count(), result.ambiguous.count()) == (0, 0)


def test_wrong_calls_fail_early(spark):
    df = spark.createDataFrame([(1, "a", "b")], NAMES)
    known = snapshots(spark)
    with pytest.raises(ValueError, match="at least one"):
        resolve_names(df, known)
    with pytest.raises(ValueError, match="no such columns"):
        resolve_names(df, known, "latin")
    with pytest.raises(ValueError, match="not text"):
        resolve_names(df, known, "key")
    with pytest.raises(ValueError, match="not a valid pattern"):
        resolve_names(df, known, "sci", sci_filters=["("])
    with pytest.raises(ValueError, match="no such result"):
        resolve_names(df, known, "sci", only="both")
    with pytest.raises(ValueError, match="columns of the result"):
        resolve_names(df.withColumnRenamed("key", "id_src"), known, "sci")


def test_no_python_and_no_cross_joins_in_the_plan(spark):
    world, rows = random_world(1)
    df = spark.createDataFrame(rows, NAMES)
    for limit in (1 << 20, 0):
        result = resolve_names(df, snapshots(spark, **world), "sci", "comm", broadcast_bytes=limit)
        alone = [
            getattr(resolve_names(df, snapshots(spark, **world), "sci", "comm", broadcast_bytes=limit, only=o), o)
            for o in ("resolved", "ambiguous")
        ]
        for frame in (*result[:2], *alone):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            for unwanted in ("Python", "Cartesian", "NestedLoop", "Window"):
                assert unwanted not in plan


def test_staged_tables_go_to_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = shared_dir(spark)
        assert folder == spark.sparkContext.getCheckpointDir()
    assert shared_dir(spark) == folder
    written = stage(spark.range(3), "probe").frame.inputFiles()
    assert written and all(folder.removeprefix("file:") in path for path in written)
