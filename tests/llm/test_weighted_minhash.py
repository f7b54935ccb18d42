"""Near-duplicate classes against all pairs."""

import os
import random

import numpy as np
import pytest

from nomenlink.llm import weighted_minhash as wm

FOLDER = "/root/testdata/sf0.001"


def classes(docs, idf):
    """Class of every row by comparing all pairs of sets that share a shingle."""
    sets = [wm.shingles(wm.word_hashes(t), idf) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if root(i) != root(j) and wm.similarity(sets[i], sets[j]) >= wm.THRESHOLD - 1e-9:
                parent[root(i)] = root(j)
    members = {}
    for i in range(len(docs)):
        members.setdefault(root(i), []).append(i)
    order = lambda i: (docs[i][0] is None, docs[i][0] or 0)
    first = {r: min(own, key=order) for r, own in members.items()}
    return [docs[first[root(i)]][0] for i in range(len(docs))]


def sort_key(r):
    return tuple((x is None, x) for x in r)


def planted(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(20, 200))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((len(docs), " ".join(copy).title()))
    return docs + [
        (500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "one two three"),
        (None, docs[0][1]), (0, docs[0][1]), (0, docs[0][1].upper()), (None, "alone of all here now"),
    ]


@pytest.mark.parametrize("block", [2048, 2])
def test_classes_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(wm, "BLOCK", block)
    monkeypatch.setattr(wm, "SET_BLOCK", block)
    docs = planted(block)
    frame = spark.createDataFrame(
        [(*d, i, "x") for i, d in enumerate(docs)], "doc_id long, text string, row int, node string"
    )
    rows = wm.near_duplicates(frame).collect()
    expected = [(d, c) for (d, _), c in zip(docs, classes(docs, wm.idf_table(frame)))]
    assert sorted(((r.doc_id, r.class_id) for r in rows), key=sort_key) == sorted(expected, key=sort_key)
    linked = {}
    for r in rows:
        if r.node is not None:
            linked.setdefault(r.class_id, []).append(r.kept)
    assert all(sum(own) == 1 for own in linked.values())
    left = wm.deduplicate(frame)
    assert left.columns == frame.columns
    kept = sorted((r.doc_id for r in rows if r.kept), key=lambda x: (x is None, x))
    assert sorted((r.doc_id for r in left.collect()), key=lambda x: (x is None, x)) == kept


def near_group(seed, n=150):
    """Many variants of one text, some of them near enough to each other."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = rng.choices(words, k=150)
    docs = []
    for i in range(n):
        copy = list(docs[rng.randrange(len(docs))][1].split()) if docs and i % 3 else list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        docs.append((i, " ".join(copy)))
    return docs


@pytest.mark.parametrize("block", [2048, 10])
def test_a_group_below_and_above_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(wm, "BLOCK", block)
    monkeypatch.setattr(wm, "SET_BLOCK", block)
    docs = near_group(8)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    expected = classes(docs, wm.idf_table(frame))
    assert 1 < len(set(expected)) < 140
    rows = wm.near_duplicates(frame).collect()
    assert sorted((r.doc_id, r.class_id) for r in rows) == [(d, c) for (d, _), c in zip(docs, expected)]


def test_samples_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(4)
    keys = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    weights = rng.uniform(1, 6, 400)
    other = weights * rng.choice([1.0, 0.5, 2.0], 400)
    a, b = (keys[:330], weights[:330]), (keys[40:], other[40:])
    expected = wm.similarity(a, b)
    found = []
    for shift in range(40):
        moved = [wm.mix64(k + np.uint64(shift)) for k, _ in (a, b)]
        sampler = wm.Sampler()
        both = sampler.sample(
            np.concatenate(moved), np.concatenate([a[1], b[1]]), np.array([0, len(moved[0])])
        )
        found.append((both[0] == both[1]).mean())
    assert abs(np.mean(found) - expected) < 0.03


def test_idf_is_bounded_and_exact(spark, monkeypatch):
    frame = spark.createDataFrame([("a b b",), ("a c",), ("a",), (None,), ("",)], "text string")
    monkeypatch.setattr(wm, "RARE", 2)
    idf = wm.idf_table(frame)
    h = wm.word_hashes
    assert np.allclose(idf.of(h("a")), np.log1p(1)) and idf.rare == np.log1p(2)
    assert np.allclose(idf.of(h("b zz")), idf.rare)
    monkeypatch.setattr(wm, "TABLE_WORDS", 1)
    assert len(wm.idf_table(frame).words) == 0


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert wm.near_duplicates(frame).collect() == [] and wm.deduplicate(frame).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query(spark):
    from nomenlink.llm.queries import op6_weighted_minhash

    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in frame.collect()]
    expected = [(d, c) for (d, _), c in zip(docs, classes(docs, wm.idf_table(frame)))]
    rows = op6_weighted_minhash(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.class_id) for r in rows) == sorted(expected)
    assert {r.doc_id for r in rows if r.kept} == {c for _, c in expected}
