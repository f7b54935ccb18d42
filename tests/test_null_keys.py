import pytest

from nomenlink.operators import joins
from nomenlink.operators.joins import attach
from nomenlink.sources.staging import stage


@pytest.mark.parametrize("how", ["left", "inner"])
def test_rows_with_a_null_key_are_not_dealt_out(spark, monkeypatch, how):
    monkeypatch.setattr(joins, "deal", lambda *a: pytest.fail("dealt"))
    rows = [(i, f"n{i}", None if i % 4 else i) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, name string, k long")
    lookup = stage(spark.createDataFrame([(i, i * 10) for i in range(0, 200, 8)], "key long, v long"), "lookup")
    got = attach(
        frame, lookup, [("k", "key")], how,
        lambda: frame.selectExpr("k AS key", "1L AS n").where("key IS NULL OR key % 8 = 0"), 0, null_keys=False,
    )
    assert got.columns == ["id", "name", "k", "v"]
    found = {(r["id"], r["v"]) for r in got.collect()}
    want = {(i, i * 10 if i % 8 == 0 else None) for i in range(200) if how == "left" or i % 8 == 0}
    assert found == want and got.count() == len(want)


def test_hot_keys_beside_null_ones(spark):
    rows = [(i, None if i % 2 else 1 if i % 4 else i) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, k long")
    lookup = stage(spark.createDataFrame([(1, 5), (4, 6)], "key long, v long"), "lookup")
    got = attach(
        frame, lookup, [("k", "key")], "left", lambda: frame.selectExpr("k AS key", "1L AS n"), 0, null_keys=False
    )
    want = sorted((i, {1: 5, 4: 6}.get(k)) for i, k in rows)
    assert sorted((r["id"], r["v"]) for r in got.collect()) == want
