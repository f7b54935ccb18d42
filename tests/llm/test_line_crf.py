"""The line model against enumeration of all labelings, and on held-out documents."""

import itertools
import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nomenlink.llm import line_crf as lc

FOLDER = "/root/testdata/sf0.1"


def enumerate_marginals(emit, transitions):
    """Marginals, transition counts and log partition by summing over all labelings."""
    n = len(emit)
    good, pairs, total = np.zeros(n), np.zeros((2, 2)), 0.0
    for states in itertools.product([0, 1], repeat=n):
        score = sum(e for e, s in zip(emit, states) if s)
        score += sum(transitions[a, b] for a, b in zip(states, states[1:]))
        w = math.exp(score)
        total += w
        good += w * np.array(states)
        for a, b in zip(states, states[1:]):
            pairs[a, b] += w
    return good / total, pairs / total, math.log(total)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 0, 6, 1, 6])
    emit = rng.normal(size=sizes.sum()) * 2
    transitions = rng.normal(size=(2, 2))
    good, pairs, log_z = lc.marginals(emit, sizes, transitions)
    at, all_good, all_pairs, all_z = 0, [], np.zeros((2, 2)), 0.0
    for n in sizes:
        g, p, z = enumerate_marginals(emit[at : at + n], transitions)
        all_good += g.tolist()
        all_pairs += p
        all_z += z
        at += n
    assert np.allclose(good, all_good) and np.allclose(pairs, all_pairs) and np.isclose(log_z, all_z)


def test_features_see_neighbours_and_lines_alone():
    texts = ["First line.\nSECOND LINE!!\n\n  \nthird ### line", None, "", "First line."]
    lines = lc.line_features(texts)
    assert lines.per_text.tolist() == [3, 0, 0, 1]
    seen = len(lc._SEEN)
    f = lines.features
    assert np.allclose(f[1, lc._OWN : lc._OWN + seen], f[0, lc._SEEN])
    assert np.allclose(f[1, lc._OWN + seen + 1 : lc._OWN + 2 * seen + 1], f[2, lc._SEEN])
    edge = [lc._OWN + seen, lc._OWN + 2 * seen + 1]
    assert f[:, edge].tolist() == [[1, 0], [0, 0], [0, 1], [1, 1]]
    alone = lc.line_features(texts[:1])
    assert np.allclose(alone.features, f[:3])


def test_scores_do_not_depend_on_the_batch():
    texts = ["Good text here.\nMore of it.", "BAD!! BAD!!", None, "x", "Good text here.\nMore of it." * 9]
    lines = lc.line_features(texts)
    model = lc.fit(lines, np.array([1.0, 0, 0, 1, 1]), steps=30)
    whole = lc.scores(model, texts)
    assert np.allclose(whole, [lc.scores(model, [t])[0] for t in texts])
    assert whole[2] == 0 and whole[0] > whole[1] and ((whole >= 0) & (whole <= 1)).all()


def test_edges(spark):
    frame = spark.createDataFrame(
        [(1, None, "p"), (2, "", "p"), (None, "Some text.", "p"), (3, "a\n" * 20_000, "p"), (3, "b" * 100_000, "p")],
        "doc_id long, text string, score string",
    )
    labels = spark.createDataFrame([(3, 1), (3, None), (None, 0), (1, 7)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        rows = lc.classify(frame, known).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert all(r.predicted == (r.score >= 0.7) for r in rows)
        assert [r.score for r in rows if r.doc_id in (1, 2)] == [0, 0]
    assert lc.classify(frame.limit(0), labels).collect() == []


def test_held_out_labels_and_other_columns_teach_nothing(spark):
    texts = ["Plain words in a line.\nAnd one more.", "LOUD!! LOUD!! LOUD!!\n### ###"]
    docs = spark.createDataFrame([(i, texts[i % 2]) for i in range(60)], "doc_id long, text string")
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = [(i, 1 - i % 2) for i in range(60)]
    wrong = [(i, q if i not in held else 1 - q) for i, q in right]
    found = []
    for labels in (right, wrong):
        frame = spark.createDataFrame(labels, "doc_id long, quality int")
        found.append(sorted(map(tuple, lc.classify(docs, frame).collect())))
    assert found[0] == found[1]
    assert [r[0] for r in found[0] if r[1]] == held
    assert all(r[3] == 1 - r[0] % 2 for r in found[0])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    from nomenlink.llm.queries import op7_line_crf

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = op7_line_crf(spark, FOLDER).where("held_out").join(labels, "doc_id")
    assert rows.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.98


def test_the_sample_is_of_labelled_texts_and_bounded_in_lines(spark, monkeypatch):
    """Ids without a text take no place, repeated ids count once, and lines are bounded."""
    good, bad = "A calm line of words.\n" * 30, "BUY NOW!! $$$ ###\n" * 30
    docs = [(i, good if i % 2 else bad) for i in range(200)]
    learning = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    many = spark.createDataFrame(docs + [docs[learning[0]]] * 300, "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(200)] + [(i, i % 2) for i in range(1000, 9000)], "doc_id long, quality int"
    )
    seen = []
    fit = lc.fit
    monkeypatch.setattr(lc, "fit", lambda lines, *rest: seen.append(lines.per_text) or fit(lines, *rest))
    model = lc.train(many, labels, fit_rows=40)
    assert len(seen[0]) == 40 and set(seen[0]) == {30}
    assert lc.scores(model, [good])[0] > 0.7 > lc.scores(model, [bad])[0]
    monkeypatch.setattr(lc, "FIT_OWN_LINES", 20)
    monkeypatch.setattr(lc, "FIT_ALL_LINES", 610)
    lc.train(many, labels)
    assert len(seen[1]) == 30 and set(seen[1]) == {20}


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(900, 0), (901, 1)], [(1, None), (2, 7)]])
def test_a_filter_without_evidence_keeps_all(spark, labels):
    docs = spark.createDataFrame([(i, f"line {i}\nother", i) for i in range(9)], "doc_id long, text string, x int")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    model = lc.train(docs, known)
    assert sorted(map(tuple, lc.filter_documents(docs, model).collect())) == sorted(map(tuple, docs.collect()))


def test_text_ids(spark):
    rows = [(i, "good words stand in this line.\n" * 3 if i % 2 else "#$% |&* ##\n" * 3, i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    texts = frame.withColumn("doc_id", frame.doc_id.cast("string"))
    a, b = (
        {int(r.doc_id): (r.held_out, round(r.score, 6)) for r in lc.classify(x.drop("quality"), x.drop("text")).collect()}
        for x in (frame, texts)
    )
    assert {k: v[0] for k, v in a.items()} == {k: v[0] for k, v in b.items()}
    assert all((b[i][1] >= 0.5) == bool(i % 2) for i in b)
