"""Codes against plain rounds over all pairs of parts and entries."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nomenlink.llm import code_compression as cc

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=16, entries=64, rounds=2):
    """Result rows by one loop after the other, over distinct ids."""
    rows = [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    sizes = [len(r[1]) for r in rows]
    size = min(set(sizes), key=lambda s: (-sizes.count(s), s)) if sizes else 0
    rows = [r for r in rows if len(r[1]) == size]
    width = -(-size // parts)
    x = []
    for r in rows:
        whole = [max(-(2**27), min(2**27, math.floor(256 * c))) for c in r[1]]
        whole += [0] * (width * parts - size)
        x.append([whole[p * width : (p + 1) * width] for p in range(parts)])
    first = {}
    for r, v in sorted(zip(rows, x), key=lambda z: (z[0][0] is None, z[0][0] or 0, z[1])):
        if r[0] is not None:
            first.setdefault(r[0], v)
    if not first:
        return []
    books = [[first[i][p] for i in sorted(first)[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = [[] for _ in books[p]]
            for v in x:
                groups[nearest(v[p], books[p])[1]].append(v[p])
            new.append(
                [
                    [sum(c) // len(g) for c in zip(*g)] if g else e
                    for g, e in zip(groups, books[p])
                ]
            )
        books = new
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in x]
    errors = [sum(d for d, _ in f) for f in found]
    digest = hashlib.sha256(
        ",".join(str(c) for book in books for e in book for c in e).encode()
    ).hexdigest()
    out = []
    for r, f, error in zip(rows, found, errors):
        alike = sum(e for q, e in zip(rows, errors) if q[2] == r[2])
        out.append((r[0], "".join(f"{k:02x}" for _, k in f), error, alike, digest))
    return sorted(out, key=str)


def digest(frame):
    return sorted(map(tuple, cc.digest(frame).collect()), key=str)


def random_rows(n, size=64, spread=1.0, seed=5):
    made = np.random.default_rng(seed).normal(size=(n, size)) * spread
    return [(i, [float(c) for c in v], i % 5 if i % 7 else None) for i, v in enumerate(made)]


def edges():
    rows = random_rows(40)
    rows += [
        (100, None, 1), (101, [], 1), (102, [None] * 64, 1), (103, [math.nan] + [0.0] * 63, 1),
        (104, [math.inf] + [0.0] * 63, 2), (105, [0.5] * 32, 2), (None, [0.25] * 64, None),
        (106, [0.0] * 64, 9), (107, [-0.0] * 64, 9), (3, [0.1] * 64, 4), (3, [0.1] * 64, 4),
        (108, [1e300] * 64, 4), (109, [-1e300] * 64, 4),
    ]
    return rows


@pytest.mark.parametrize(
    "rows",
    [edges(), random_rows(30), random_rows(200, 20, 0.02), [(i, [0.5] * 16, None) for i in range(90)],
     [(None, [0.5] * 64, 1)], []],
    ids=["edges", "fewer rows than entries", "ties and filled parts", "equal", "no id", "empty"],
)
def test_equals_the_plain_rounds(spark, rows):
    assert digest(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows)


def test_other_types_and_clashing_names(spark):
    rows = random_rows(80)
    frame = spark.createDataFrame(rows, SCHEMA)
    clash = frame
    for name in ("x", "size", "n", "part", "entry", "code", "error", "order", "centre"):
        clash = clash.withColumn(name, F.lit("x"))
    assert digest(clash) == plain(rows)
    text = frame.withColumn("vec_id", F.format_string("%05d", "vec_id")).drop("label")
    expected = plain([(i, v, None) for i, v, _ in rows])
    assert [(int(r[0]), *r[1:]) for r in digest(text)] == sorted(expected, key=lambda r: r[0])
    with pytest.raises(ValueError):
        cc.compress(frame, entries=300)


def test_large_ids_stay_exact(spark):
    rows = [(2**60 + i, v, n) for i, v, n in random_rows(20)] + [(None, [0.1] * 64, 1)]
    assert digest(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_more_than_one_chunk(spark):
    rows = random_rows(cc.CHUNK + 300, 32, 0.1)
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    coded, books = cc.compress(frame, parts=8, entries=16, rounds=1)
    expected = plain(rows, 8, 16, 1)
    assert sorted((r.vec_id, r.code, r.error) for r in coded.collect()) == sorted(r[:3] for r in expected)
    assert cc.books_sha256(books) == expected[0][-1]


def shapes():
    rng = np.random.default_rng(11)
    yield rng.integers(-60, 60, (900, 4))
    yield rng.integers(-2, 3, (900, 4))
    yield np.repeat(rng.integers(-500, 500, (30, 4)), 30, 0)
    yield np.zeros((64, 4), np.int64)
    yield np.concatenate([rng.integers(-3, 3, (400, 4)), rng.integers(-3, 3, (400, 4)) + 100000])


@pytest.mark.parametrize("leaf", [1, 8])
@pytest.mark.parametrize("x", list(shapes()), ids=["wide", "ties", "copies", "equal", "far"])
def test_trees_cover_their_points(x, leaf):
    trees = cc.plant(x, 2, leaf)
    assert sorted(trees.order) == list(range(len(x)))
    for node in range(len(trees.start)):
        mine = trees.order[trees.start[node] : trees.end[node]]
        away = np.sqrt(((x[mine] - x[trees.centre[node]]) ** 2).sum(1))
        assert trees.centre[node] in mine and away.max() == trees.radius[node]
        below = range(trees.child[node], trees.child[node] + trees.children[node])
        if trees.children[node]:
            assert [trees.start[c] for c in below] == [trees.start[node], *(trees.end[c] for c in below)][:-1]
            assert trees.end[below[-1]] == trees.end[node]
            assert trees.centre[below[0]] == trees.centre[node]
            # Centres of one node are further apart than the radius of their level.
            apart = x[trees.centre[list(below)]]
            gaps = np.sqrt(((apart[:, None] - apart[None]) ** 2).sum(-1))
            assert (gaps + np.eye(len(gaps)) * 1e9).min() > trees.radius[list(below)].max()
        else:
            assert trees.end[node] - trees.start[node] <= leaf or trees.radius[node] == 0


@pytest.mark.parametrize("x", list(shapes()), ids=["wide", "ties", "copies", "equal", "far"])
def test_assignment_is_exact(x):
    books = np.stack([x[:30], x[len(x) // 2 :][:30]])
    trees = cc.plant(x, 2)
    squares = ((x.reshape(2, -1, 1, 4) - books[:, None]) ** 2).sum(-1)
    entry, errors = cc.codes(trees, x, books)
    assert (entry.T == squares.argmin(-1)).all() and (errors == squares.min(-1).sum(0)).all()
    counts, sums = cc.totals(trees, x, books)
    for p in range(2):
        for k in range(30):
            mine = x.reshape(2, -1, 4)[p][squares[p].argmin(-1) == k]
            assert counts[p, k] == len(mine) and (sums[p, k] == mine.sum(0)).all()


def test_whole_subtrees_are_settled_by_bounds():
    rng = np.random.default_rng(2)
    centres = rng.integers(-1000, 1000, (8, 4))
    x = centres[rng.integers(0, 8, 2000)] + rng.integers(-20, 20, (2000, 4))
    trees = cc.plant(x, 1)
    start, end, _, alone = cc.assign(trees, x, centres[None])
    assert (end - start)[~alone].sum() == len(x) and len(start) < 100
