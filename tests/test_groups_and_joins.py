import random

import pytest
from pyspark.sql import functions as F

from nomenlink import keep_if_any
from nomenlink.operators.groups import keep_best_tier, preference
from nomenlink.operators.joins import attach, deal
from nomenlink.sources.staging import Staged, stage, stage_unless_small


def test_keep_if_any(spark):
    rows = spark.createDataFrame(
        [("a", 1, True), ("a", 2, False), ("a", 3, None), ("b", 4, False), ("b", 5, None)],
        "k string, v int, p boolean",
    )
    kept = keep_if_any(rows, ["k"], F.col("p")).select("k", "v").collect()
    assert sorted(map(tuple, kept)) == [("a", 1), ("b", 4), ("b", 5)]


def test_preference_equals_keep_if_any_in_turn(spark):
    chance = random.Random(1)
    choice = [True, False, None]
    rows = [
        (chance.randint(0, 40), i, chance.choice(choice), chance.choice(choice))
        for i in range(150)
    ]
    df = spark.createDataFrame(rows, "k int, v int, p boolean, q boolean")
    turns = keep_if_any(keep_if_any(df, ["k"], F.col("p")), ["k"], F.col("q"))
    tiers = keep_best_tier(
        df.withColumn("t", preference(F.col("p"), F.col("q"))), ["k"], "t",
        n=F.count(F.lit(1)),
    )
    want = {r["v"] for r in turns.collect()}
    got = tiers.collect()
    assert {r["v"] for r in got} == want
    counts = {}
    for r in got:
        counts[r["k"]] = counts.get(r["k"], 0) + 1
    assert all(r["n"] == counts[r["k"]] for r in got)


def test_group_tests_in_turn_run_their_input_once(spark):
    lines = spark.range(40).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    once = lines.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))

    def reads(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Range ("), plan.count("Relation [")

    kept = once
    for least in (10, 20, 30):
        kept = keep_if_any(kept, ["k"], F.col("v") >= least)
        # The rows and their groups, read from what was written.
        assert reads(kept) == (0, 2)
    tiers = keep_best_tier(kept.withColumn("t", preference(F.col("v") > 35)), ["k"], "t", m=F.max("v"))
    assert reads(tiers) == (0, 2)
    best = {k: [v for v in range(30, 40) if v % 7 == k] for k in range(7)}
    want = {v for vs in best.values() for v in ([v for v in vs if v > 35] or vs)}
    assert {r["v"] for r in tiers.collect()} == want


def shape(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_gives_the_same_rows_by_every_way(spark, how):
    # A third of the rows share one key, another third have none.
    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i % 50}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, k string")
    lookup = [("hot", 1), ("hot", 2), ("k2", 3), ("k5", 4), ("unused", 5)]
    table = stage(spark.createDataFrame(lookup, "k string, v int"), "lookup")
    asked = []

    def counts():
        asked.append(True)
        return df.groupBy("k").agg(F.count("*").alias("n"))

    small = attach(df, table, [("k", "k")], how, counts)
    assert not asked
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    want = shape(small, ["id", "k", "v"])
    # Whatever the limit, a lookup above it is joined with the hot keys dealt out.
    for size, limit in ((1 << 40, 1 << 25), (1 << 40, 600), (table.size, 0)):
        dealt = attach(df, Staged(table.frame, table.rows, size), [("k", "k")], how, counts, limit)
        assert asked and dealt.columns == ["id", "k", "v"]
        plan = dealt._jdf.queryExecution().optimizedPlan().toString()
        # The rows come from what was written with their shares, not from where they lay.
        assert "_join_salt" in plan and "monotonically" not in plan and "LogicalRDD" not in plan
        assert shape(dealt, ["id", "k", "v"]) == want
    # 1000 hot rows match twice; of the others, k2 and k5 match once.
    others = sum(k in ("k2", "k5") for _, k in rows)
    unmatched = 2000 - others if how == "left" else 0
    assert len(want) == 2000 + others + unmatched


def test_no_task_gets_much_more_than_its_share(spark):
    """The rows of a hot key, and of a null key, spread over the partitions of the join."""
    df = spark.range(9000, numPartitions=3).selectExpr(
        "id", "CASE id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN NULL ELSE 'k' || id END AS k"
    )
    table = stage(spark.createDataFrame([("hot", 1), (None, 2)], "k string, v int"), "lookup")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = attach(df, table, [("k", "k")], "left", lambda: df.groupBy("k").agg(F.count("*").alias("n")), 0)
        sizes = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(r["count"] for r in sizes) == 9000
    assert max(r["count"] for r in sizes) < 3 * 9000 / 12


def test_shares_stay_when_the_rows_come_in_another_order(spark, tmp_path):
    """The files of the input change places between two readings of the joined rows."""
    places = [str(tmp_path / x) for x in "abc"]
    for i, place in enumerate(places):
        spark.range(i * 100, i * 100 + 50 * (i + 1)).selectExpr("id", "'hot' AS k").coalesce(1).write.parquet(place)
    df = spark.read.parquet(*places)
    hot = df.select(F.xxhash64("k").alias("_join_hash")).distinct().withColumn("_shares", F.lit(4))
    by_turn = {tuple(r) for r in deal(df, hot, ["k"]).select("id", "_join_salt").collect()}
    moved = spark.read.parquet(*reversed(places)).coalesce(1)
    assert by_turn != {tuple(r) for r in deal(moved, hot, ["k"]).select("id", "_join_salt").collect()}

    table = stage(spark.createDataFrame([("hot", 1)], "k string, v int"), "lookup")
    rows = df.orderBy(F.rand())
    counts = lambda: df.groupBy("k").agg(F.count("*").alias("n"))
    out = attach(rows, table, [("k", "k")], "inner", counts, 0)
    # Every evaluation draws another order of the source, and none of them is seen.
    seen = [sorted(map(tuple, out.withColumn("p", F.spark_partition_id()).collect())) for _ in range(3)]
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == df.count()


def test_equal_rows_have_shares_of_their_own(spark):
    df = spark.range(400).selectExpr("'hot' AS k")
    hot = df.select(F.xxhash64("k").alias("_join_hash")).distinct().withColumn("_shares", F.lit(4))
    sizes = [r["count"] for r in deal(df, hot, ["k"]).groupBy("_join_salt").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 120


def test_stage_measures_lists(spark):
    df = spark.createDataFrame(
        [([("ab", 1), (None, 2)],), ([],), (None,)], "l array<struct<s:string,v:int>>"
    )
    assert stage(df, "lists").size == 3 * 16 + 2 * 32 + 2


def test_attach_matches_null_keys(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "a", None), (3, "a", "x")], "id int, a string, b string")
    table = stage(
        spark.createDataFrame([(None, "x", 10), ("a", None, 20)], "a string, b string, v int"), "t"
    )
    counts = lambda: df.groupBy("a", "b").agg(F.count("*").alias("n"))
    for limit in (1 << 20, 0):
        got = attach(df, table, [("a", "a"), ("b", "b")], "left", counts, limit)
        assert shape(got, ["id", "v"]) == [(1, 10), (2, 20), (3, None)]


def test_stage_measures_what_it_writes(spark):
    df = spark.createDataFrame([("ab", 1), (None, 2), ("é", 3)], "s string, v int")
    table = stage(df, "measured")
    assert (table.rows, table.size) == (3, 3 * 32 + 2 + 2)
    assert shape(table.frame, ["s", "v"]) == shape(df, ["s", "v"])
    empty = stage(df.where("v > 9"), "empty")
    assert (empty.rows, empty.size, empty.frame.count()) == (0, 0, 0)


def test_a_bounded_frame_is_not_written(spark):
    source = stage(spark.range(10).withColumn("s", F.lit("x")), "source")
    lazy = stage_unless_small(source.frame.select("s"), "part", source, 1 << 20)
    assert lazy.size >= stage(lazy.frame, "measured").size
    written = stage_unless_small(source.frame.select("s"), "part", source, 10)
    assert written.frame.inputFiles() != source.frame.inputFiles()
