"""Snapshots in their written layout: equal results, checked key, no shuffle of their side."""

import uuid

import pytest

from nomenlink import PreparedAuthorities, resolve_names
from nomenlink.operators import lookups
from nomenlink.sources import prepared as layout
from nomenlink.sources.staging import shared_dir

from test_policies import names, snapshots
from test_resolve import NAMES, Naive, as_sets, random_world

TAXON = (1, "GADUS MORHUA", "accepted", 1, "GADUS MORHUA")


def folder(spark):
    return f"{shared_dir(spark)}/prepared-{uuid.uuid4().hex}"


def prepared(spark, **tables):
    return PreparedAuthorities.prepare(snapshots(spark, **tables), folder(spark))


@pytest.fixture
def nothing_small(spark):
    """Joins that shuffle, as on large tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_resolves_as_the_naive_passes(spark, nothing_small):
    world, rows = random_world(21)
    known = prepared(spark, **world)
    got = as_sets(resolve_names(spark.createDataFrame(rows, NAMES), known, "sci", "comm"))
    naive = Naive(world)
    assert got == {k: naive.row(s, c) for k, s, c in rows}


def exchanges(frame):
    """The lines of the physical plan that shuffle, each with the line below it."""
    plan = frame._jdf.queryExecution().executedPlan().toString().splitlines()
    return [(a, b) for a, b in zip(plan, plan[1:]) if "Exchange hashpartitioning" in a]


def test_no_lookup_by_key_shuffles_the_snapshot(spark, nothing_small):
    world, _ = random_world(22)
    known, plain = prepared(spark, **world), snapshots(spark, **world)
    searched = names(spark, "GADU", "ALBA NOVA").distinct()
    sent = spark.createDataFrame([(1,), (105,)], "code long").distinct()

    def sides(authorities):
        yield lookups.search_worms(searched, authorities, "scientific")
        yield lookups.best_match(searched, authorities, "scientific")
        yield lookups.tsns_of(sent, authorities)
        yield lookups.with_accepted(sent.withColumnRenamed("code", "tsn"), authorities)

    for lean, full in zip(sides(known), sides(plain)):
        # The names or codes move; a scan of the snapshot never lies under a shuffle.
        under = [below for _, below in exchanges(lean)]
        assert not any("Scan parquet" in below or "aphia_id IS NOT NULL" in below for below in under)
        assert len(exchanges(lean)) < len(exchanges(full))
        assert sorted(map(str, lean.collect())) == sorted(map(str, full.collect()))
        assert "Bucketed: true" in lean._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "taxa",
    [
        [TAXON, (1, "GADUS", "accepted", 1, "GADUS")],
        [TAXON, (None, "GADUS", "accepted", 1, "GADUS")],
    ],
)
def test_a_broken_key_is_an_error(spark, taxa):
    with pytest.raises(ValueError, match="aphia_id"):
        prepared(spark, worms_taxa=taxa)


def test_a_repeated_line_is_one_record(spark):
    known = prepared(spark, worms_taxa=[TAXON, TAXON, (1, "gadus morhua ", "accepted", 1, "Gadus morhua")])
    columns = ["aphia_id", "scientificname", "status", "valid_aphia_id", "valid_name"]
    for table in (known.worms_taxa, known.taxa_by_name):
        assert [tuple(r) for r in table.select(*columns).collect()] == [TAXON]


def test_lines_that_no_search_meets_are_left_out(spark):
    known = prepared(
        spark, worms_taxa=[TAXON, (2, None, None, None, None)], xwalk=[(1, 11), (None, 12), (3, None)]
    )
    assert known.worms_taxa.count() == 2 and known.taxa_by_name.count() == 1
    for table in (known.xwalk, known.links_by_tsn):
        assert [(r["aphia_id"], r["tsn"]) for r in table.collect()] == [(1, 11)]


def test_a_table_with_a_hot_key_has_no_buckets(spark, monkeypatch):
    links = [(1, t) for t in range(20_000)] + [(a, a) for a in range(2, 20_000)]
    known = prepared(spark, worms_taxa=[TAXON], xwalk=links)
    # Below the share a key may have of four buckets.
    assert known.xwalk._jdf.queryExecution().executedPlan().toString().count("Bucketed: true") <= 1
    monkeypatch.setattr(layout, "HOT_BUCKETS", 1)
    hot = prepared(spark, worms_taxa=[TAXON], xwalk=links)
    lines = spark.read.parquet(f"{hot.xwalk.inputFiles()[0].rsplit('/', 2)[0]}/layout").collect()
    buckets = {r["name"]: r["buckets"] for r in lines}
    assert buckets["xwalk"] == 0 and buckets["xwalk_by_tsn"] > 0
    assert sorted(map(tuple, hot.xwalk.collect())) == sorted(map(tuple, known.xwalk.collect()))


def test_another_session_opens_the_folder(spark):
    at = folder(spark)
    made = PreparedAuthorities.prepare(snapshots(spark, worms_taxa=[TAXON]), at)
    spark.sql(f"DROP TABLE {layout._table(at, 'worms_taxa')}")
    again = PreparedAuthorities.open(spark, at)
    assert again.worms_taxa.collect() == made.taxa_by_name.collect() and again.staged() is again
    with pytest.raises(Exception, match="(?i)exist"):
        PreparedAuthorities.prepare(snapshots(spark, worms_taxa=[TAXON]), at)
    with pytest.raises(ValueError, match="prepare"):
        PreparedAuthorities(**{n: getattr(again, n) for n in (
            "worms_taxa", "worms_vernacular", "itis_names", "itis_vernacular", "itis_units",
            "itis_synonyms", "xwalk",
        )})
