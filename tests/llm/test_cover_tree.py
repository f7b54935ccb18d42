"""Embedding links against all pairs in double precision."""

import os

import numpy as np
import pytest

from nomenlink.llm import cover_tree as ct

FOLDER = "/root/testdata/sf0.001"


def expected_rows(ids, vectors, threshold=0.95):
    """Links and components from the whole matrix of cosines."""
    usable = [
        v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        for v in vectors
    ]
    n = len(ids)
    links = np.zeros((n, n), bool)
    at = [i for i in range(n) if usable[i]]
    x = np.array([vectors[i] for i in at], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links[np.ix_(at, at)] = x @ x.T >= threshold
    np.fill_diagonal(links, False)
    part = list(range(n))
    for i in range(n):
        stack = [i] if part[i] == i else []
        while stack:
            k = stack.pop()
            for j in np.flatnonzero(links[k]):
                if part[j] == j and j > i:
                    part[j] = i
                    stack.append(j)
    out = []
    for i in range(n):
        own = [ids[j] for j in range(n) if part[j] == part[i] and ids[j] is not None]
        least = min(own, default=None)
        out.append((ids[i], int(links[i].sum()), least, ids[i] == least))
    return sorted(out, key=str)


def clumps(seed, n=400):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    spread = rng.choice([0.001, 0.02, 0.06, 0.12, 0.3], 12)
    own = rng.integers(0, 12, n)
    x = (centres[own] + spread[own][:, None] * rng.normal(size=(n, 8))).astype(np.float32)
    x[rng.integers(0, n, 40)] = x[0]
    return [r.tolist() for r in x]


def run(spark, ids, vectors, kind="float"):
    rows = list(zip(ids, vectors, [7] * len(ids), ["x"] * len(ids)))
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, n int, point string")
    return sorted((tuple(r) for r in ct.near_duplicates(frame).collect()), key=str)


@pytest.mark.parametrize(("seed", "block", "kind"), [(1, 2048, "float"), (2, 64, "float"), (3, 16, "double")])
def test_links_equal_all_pairs(spark, monkeypatch, seed, block, kind):
    monkeypatch.setattr(ct, "BLOCK", block)
    vectors = clumps(seed)
    assert run(spark, list(range(400)), vectors, kind) == expected_rows(list(range(400)), vectors)


def test_edges(spark):
    a, b = [1.0] * 8, [1.0, -1.0] * 4
    vectors = [a, a, b, None, [0.0] * 8, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] * 8]
    vectors += [[1.0, 2.0], [], [2.0] * 8, a, [x * 3 for x in b], [1e-30] * 8]
    ids = [5, 4, 9, 10, 11, 12, 13, 14, 15, 16, 17, None, 9, None]
    assert run(spark, ids, vectors) == expected_rows(ids, vectors)
    assert run(spark, [], []) == []
    assert run(spark, [1, 2], [None, []]) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert run(spark, [3], [a]) == [(3, 0, 3, True)]


def test_a_dense_group_is_linked_by_its_nodes():
    rng = np.random.default_rng(5)
    x = ct.unit(np.ones(16) + 0.01 * rng.normal(size=(600, 16)))
    tree = ct.build(x, ct.nested_levels(x, ct.link_radius(0.95)))
    one = np.ones(600, np.int64)
    links, _, roots = ct.dual_traversal(tree, tree, one, one, 0.95, True)
    assert (links == 599).all() and (roots == 0).all()
    other, same, roots = ct.dual_traversal(tree, tree, one, 2 * one, 0.95, False)
    assert (other == 1200).all() and (same == 600).all() and len(set(roots.tolist())) == 1


def test_levels_are_nested_and_cover():
    x = ct.unit(np.array(clumps(9)))
    levels = ct.nested_levels(x, 0.3)
    for k, node in enumerate(levels):
        reach = 0.3 * 2.0 ** (1 - k)
        for own in np.unique(node):
            rows = np.flatnonzero(node == own)
            assert (ct.distances(x[rows[:1]], x[rows]) <= reach + 1e-9).all()
            if k:
                assert len(set(levels[k - 1][rows].tolist())) == 1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query(spark):
    from nomenlink.llm.queries import op1_cover_tree

    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r for r in op1_cover_tree(spark, FOLDER).collect()}
    assert [got[r.vec_id].n_links for r in rows] == links.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
