"""Toxicity: the index against brute force, the query against a plain form, and labels."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nomenlink.llm import nearest_examples as ne

FOLDER = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def random_counts(rng, n, terms, most):
    return [
        {int(t): int(rng.integers(1, 5)) for t in rng.choice(terms, rng.integers(0, most), False)}
        for _ in range(n)
    ]


@pytest.mark.parametrize("terms, most", [(40, 6), (300, 40), (5, 3)])
@pytest.mark.parametrize("n", [1, 10, 700])
def test_index_finds_the_exact_neighbours(terms, most, n):
    rng = np.random.default_rng(n + terms)
    counts = random_counts(rng, n, terms, most)
    labels = rng.integers(0, 2, n)
    idf = rng.random(terms) * 5 + 0.1
    index = ne.build_index(list(range(n)), labels, counts, idf)
    queries = ne.unit_weights(random_counts(rng, 200, terms, most), idf)
    whole = ne.unit_weights(counts, idf)
    shares, near = ne.votes(index, queries, 15, 0.1)
    for (who, similar), query, share in zip(near, queries, shares):
        if not query.any():
            empty = [labels[i] for i in range(n) if not counts[i]]
            assert share == (np.mean(empty) if empty else 0.1)
            continue
        exact = whole @ query
        full = np.sort(exact[[i for i in range(n) if counts[i]]])[::-1]
        limit = full[14] if len(full) > 15 else 0
        expected = {i: exact[i] for i in range(n) if exact[i] >= limit - ne.EQUAL and exact[i] > 0}
        assert {index.ids[k] for k in who} == set(expected)
        assert np.allclose(sorted(similar), sorted(expected.values()), atol=1e-12)
        weight = {i: 1 / (1 - min(c, 1) + ne.SOFT) ** 2 - 1 / (1 + ne.SOFT) ** 2 for i, c in expected.items()}
        base = 15 * (1 / (0.5 + ne.SOFT) ** 2 - 1 / (1 + ne.SOFT) ** 2)
        wanted = (sum(w * labels[i] for i, w in weight.items()) + base * 0.1) / (sum(weight.values()) + base)
        assert abs(share - wanted) < 1e-9
    assert sorted(index.ids) == list(range(n))


def test_blocks_are_skipped():
    rng = np.random.default_rng(3)
    counts = [{int(i % 40): 3, 40 + int(rng.integers(0, 5)): 1} for i in range(4000)]
    index = ne.build_index(list(range(4000)), np.zeros(4000, int), counts, np.ones(45))
    queries = ne.unit_weights([{7: 2, 41: 1}, {20: 1}], np.ones(45))
    assert (ne.similarities(index, queries, 15) >= 0).mean() < 0.2


def test_an_example_can_leave_itself_out():
    counts = [{0: 1}, {0: 1, 1: 1}, {1: 2}]
    index = ne.build_index([10, 11, 12], np.array([1, 0, 0]), counts, np.ones(2))
    queries = ne.unit_weights([counts[i - 10] for i in index.ids], np.ones(2))
    found = ne.similarities(index, queries, 15, np.arange(3))
    assert (np.diag(found) == -1).all() and (found >= 0).sum() >= 4


def test_words_of_long_and_odd_texts():
    for text in ["", None, "A b-a", "x" * 3_000_000, "Öl_öl " * 400_000, "a" * ne._PIECE + "b c"]:
        plain = Counter(re.findall(r"[^\W_]+", (text or "").lower()))
        assert ne.words(text) == plain
    assert ne.terms_of("abcde") == ["abcde", "abc-", "abcd-"] and ne.terms_of("abc") == ["abc"]


def learnable(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 != 0


def made(n=600):
    """Clean rows of drawn words, and toxic ones with a word of their own besides."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = " ".join(f"w{k}" for k in rng.integers(0, 3000, rng.integers(5, 60)))
        rows.append((i, text + (f" vile{'abc'[i % 3]} rot" if toxic else "")))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_signs_of_a_class_are_found(spark):
    rows, labels = made()
    docs = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame(labels, LABELS)
    found = {r.doc_id: r for r in ne.classify(docs, known).collect()}
    assert all(found[i].predicted == t for i, _, t in labels)
    assert all(found[i].held_out == (not learnable(i)) for i, _ in rows)
    model, counted = ne.train(docs, known)
    assert {"rot", "vile-", "vil-"} <= set(model.terms) and not any(t.startswith("w") for t in model.terms)
    with_evidence = ne.score_counts(counted, model, evidence=True)
    for r in with_evidence.where("doc_id % 4 = 0").limit(20).collect():
        assert all(e.toxic == 1 and learnable(e.example) for e in r.evidence)
        assert [e.similarity for e in r.evidence] == sorted((e.similarity for e in r.evidence), reverse=True)


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = made()
    docs = spark.createDataFrame(rows, DOCS)
    other = [(i, q, t if learnable(i) else 1 - t) for i, q, t in labels]
    a, b = (
        sorted(map(tuple, ne.classify(docs, spark.createDataFrame(x, LABELS)).collect()))
        for x in (labels, other)
    )
    assert a == b


def test_edges(spark):
    rows, labels = made(300)
    rows += [(None, "vilea rot"), (None, None), (1000, None), (1001, ""), (1002, "rot " * 300_000)]
    rows += [rows[4]] * 200
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("x")).withColumn("toxic", F.lit("x"))
    labels += [(None, 0, 1), (5, 1, None), (7, 1, 9), (3000, 0, 1), (4, 1, 1)]
    out = ne.classify(docs, spark.createDataFrame(labels, LABELS))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    found = [tuple(r) for r in out.collect()]
    assert len(found) == len(rows) and all(0 <= r[2] <= 1 for r in found)
    by_id = {r[0]: r for r in found if r[0] is not None}
    assert by_id[1000][2:] == by_id[1001][2:] and by_id[1001][3] == 0
    assert by_id[1002][3] == 1
    assert sorted(r[3] for r in found if r[0] is None) == [0, 1]
    assert not any(r[1] for r in found if r[0] is None)
    assert len({r[2] for r in found if r[0] == 4}) == 1


@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (2, 1, 1)], [(1, 1, 0)]])
def test_without_both_classes(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], DOCS)
    scores = {r.score for r in ne.classify(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert len(scores) == 1
    learnt = [t for i, _, t in labels if learnable(i)]
    assert abs(scores.pop() - (np.mean(learnt) if learnt else 0)) < 1e-6


def test_empty_table_and_text_ids(spark):
    rows, labels = made(200)
    known = spark.createDataFrame(labels, LABELS)
    assert ne.classify(spark.createDataFrame([], DOCS), known).collect() == []
    as_text = F.format_string("%d", "doc_id")
    docs = spark.createDataFrame(rows, DOCS)
    a = {r.doc_id: r.score for r in ne.classify(docs, known).collect()}
    texts = ne.classify(docs.withColumn("doc_id", as_text), known.withColumn("doc_id", as_text))
    b = {int(r.doc_id): r.score for r in texts.collect()}
    assert all(abs(a[i] - b[i]) < 0.05 for i in a)


def test_near_copies_are_one_example(spark):
    rows, labels = made()
    rng = np.random.default_rng(9)
    long = [f"w{k}" for k in rng.integers(0, 3000, 400)]
    for i in range(300):
        copy = list(long)
        copy[i % 400] = "other"
        rows.append((2000 + i, " ".join([*copy, "quirk"])))
        labels.append((2000 + i, 1, 1))
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    assert "quirk" not in ne.train(docs, known)[0].terms


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = ne.classify(docs, labels).where("held_out").join(labels, "doc_id").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    # About one in seven labelled so has no word that others labelled so have.
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.02
