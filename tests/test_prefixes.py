"""Prefix search against a test of every pair."""

import random

import pytest
from pyspark.sql import functions as F

from nomenlink.operators.prefixes import prefix_matches


def plain(names, known, whole_words):
    return sorted(
        (n, t, v)
        for n in names if n is not None
        for t, v in known if t is not None
        if (t == n or t.startswith(n + " ") if whole_words else t.startswith(n))
    )


def found(spark, names, known, whole_words):
    left = spark.createDataFrame([(n,) for n in names], "name string")
    right = spark.createDataFrame(known, "text string, v int")
    out = prefix_matches(left, right, whole_words=whole_words)
    assert out.columns == ["name", "text", "v"]
    return sorted(map(tuple, out.collect()))


def random_names(seed, n):
    chance = random.Random(seed)
    letters = ["A", "B", "É", "日", " ", "!", "\x00", "~", "\U0010ffff"]
    return ["".join(chance.choices(letters, k=chance.randint(0, 7))) for _ in range(n)]


@pytest.mark.parametrize("whole_words", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_test_of_every_pair(spark, seed, whole_words):
    names = sorted(set(random_names(seed, 150))) + [None]
    known = [(t, i) for i, t in enumerate(random_names(seed + 10, 400))] + [(None, -1)]
    assert found(spark, names, known, whole_words) == plain(names, known, whole_words)


def test_names_that_hold_each_other(spark):
    known = [("A" * k + t, k) for k in range(60) for t in ("", " X", "B")]
    names = ["A" * k for k in range(60)]
    for whole_words in (False, True):
        assert found(spark, names, known, whole_words) == plain(names, known, whole_words)


def test_many_matches_of_one_name_part(spark):
    """More texts than one row numbers at once, equal ones as well, over all partitions."""
    known = [("COD", i) for i in range(5000)] + [(f"COD {i}", i) for i in range(4000)]
    names = ["COD", "CO", "COD 1", "EEL"]
    assert found(spark, names, known, False) == plain(names, known, False)


def test_no_more_rows_than_matches_and_bounds(spark):
    known = spark.createDataFrame([("X" * 300 + str(i), i) for i in range(500)], "text string, v int")
    names = spark.createDataFrame([(f"Y{i}",) for i in range(200)] + [("X" * 300 + "7",)], "name string")
    out = prefix_matches(names, known)
    assert out.count() == sum(str(i).startswith("7") for i in range(500))
    plan = out._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("Python", "Cartesian", "NestedLoop"):
        assert unwanted not in plan


def test_columns_that_must_be_equal(spark):
    names = spark.createDataFrame([("a", "COD"), ("b", "COD"), ("b", "EEL")], "k string, name string")
    known = spark.createDataFrame([("a", "COD 1", 1), ("b", "EEL 2", 2), ("c", "COD 3", 3)], "k string, text string, v int")
    rows = prefix_matches(names, known, by=["k"], whole_words=True).collect()
    assert sorted(map(tuple, rows)) == [("a", "COD", "COD 1", 1), ("b", "EEL", "EEL 2", 2)]


def test_empty_sides(spark):
    assert found(spark, [], [("A", 1)], False) == [] and found(spark, ["A"], [], True) == []
