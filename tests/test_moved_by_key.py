from pyspark.sql import functions as F

from nomenlink import keep_if_any
from nomenlink.plans.incremental import AnswerStore, _Changes
from test_policies import snapshots


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_store_or_group_is_sent_whole(spark, tmp_path):
    store = AnswerStore.create(spark, f"file:{tmp_path}/store")
    links = spark.createDataFrame([], store.links.schema)
    store.links.upsert(links, spark.createDataFrame([(1, "TSN")], "sent long, code_type string"))
    rows = spark.createDataFrame([("a", 1)], "k string, v int")
    for frame in (store.links.read(), keep_if_any(rows, ["k"], F.col("v") > 0)):
        assert "SortMergeJoin" in plan(frame) and "Broadcast" not in plan(frame)


def test_changed_lines_are_found_once(spark):
    old = snapshots(spark, xwalk=[(1, 5), (1, 5), (2, None), (3, 7)])
    new = snapshots(spark, xwalk=[(1, 5), (2, None), (None, 4), (3, 8), (3, 8)])
    found = _Changes(old, new)
    got = {tuple(r) for r in found.lines("xwalk").collect()}
    assert got == {(3, 7), (3, 8), (None, 4)}
    # What follows reads the written lines.
    assert found.lines("xwalk") is found.lines("xwalk")
    assert "Aggregate" not in plan(found.lines("xwalk"))
