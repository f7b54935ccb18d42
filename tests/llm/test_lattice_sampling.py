"""Sampled segmentations against the exact path distribution, and lossless decoding."""

import itertools
import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nomenlink.llm import lattice_sampling as ls

FOLDER = "/root/testdata/sf0.001"
TEXTS = [
    "", " ", "   ", "a", "the cat", "  two  blanks ", "line\nfeed\ttab", "▁sign ▁", "日本語 text 😀",
    "é" * 40, "x" * 3000, "\x00\x01", "á b", "The quick brown fox. " * 30,
]


def paths(part, vocab):
    """All segmentations of a part with their shares of the weight."""
    known = {s: i for i, s in enumerate(vocab.strings) if i >= 259}
    found = {}
    for cuts in itertools.product([0, 1], repeat=len(part) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(part)]
        spans = [part[a:b] for a, b in zip([0, *ends], ends)]
        if all(s in known for s in spans):
            ids = tuple(known[s] for s in spans)
            found[ids] = math.exp(sum(vocab.log_weight[i] for i in ids))
    total = sum(found.values())
    return {ids: w / total for ids, w in found.items()}


@pytest.mark.parametrize(("part", "alpha"), [(" the", 1.0), (" other", 0.3), (" in", 0.0)])
def test_draws_follow_the_weight_of_the_paths(part, alpha):
    vocab = ls.vocabulary(None, alpha)
    expected = paths(part, vocab)
    n = 20_000
    lattice = ls.Lattices([" x", part], vocab)
    out, counts = lattice.sample(np.ones(n, np.int64), ls.mix64(np.arange(n)))
    found = {}
    for ids in np.split(out, np.cumsum(counts)[:-1]):
        found[tuple(ids.tolist())] = found.get(tuple(ids.tolist()), 0) + 1 / n
    assert found.keys() <= expected.keys()
    for ids, share in expected.items():
        assert abs(found.get(ids, 0) - share) < 0.015


def test_forward_sums_are_those_of_all_paths():
    vocab = ls.vocabulary(None, 1.0)
    known = {s: i for i, s in enumerate(vocab.strings) if i >= 259}
    part = " anothers"
    total = [0.0] * (len(part) + 1)
    total[0] = 1.0
    for b in range(1, len(part) + 1):
        for a in range(b):
            if part[a:b] in known:
                total[b] += total[a] * math.exp(vocab.log_weight[known[part[a:b]]])
    lattice = ls.Lattices([part], vocab)
    assert np.allclose(np.exp(lattice.total), total)


def test_samples_decode_and_depend_on_the_key_alone(monkeypatch):
    vocab = ls.vocabulary(None, 0.5)
    seeds = ls.mix64(np.arange(len(TEXTS)))
    whole = ls.sample_batch(TEXTS, seeds, vocab)
    assert [ls.decode_ids(i, vocab) for i in whole] == TEXTS
    single = [ls.sample_batch([t], seeds[i : i + 1], vocab)[0] for i, t in enumerate(TEXTS)]
    assert [x.tolist() for x in single] == [x.tolist() for x in whole]
    monkeypatch.setattr(ls, "HELD", 5)
    parts = ls.sample_batch(TEXTS, seeds, vocab)
    assert [x.tolist() for x in parts] == [x.tolist() for x in whole]
    other = ls.sample_batch(TEXTS, ls.mix64(np.arange(len(TEXTS)) + 99), vocab)
    assert other[-1].tolist() != whole[-1].tolist()


def test_columns(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(90, None, "s"), (None, "no key", "s"), (4, "the cat", "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = {r.doc_id: r for r in ls.digest(frame).repartition(3).collect()}
    assert found[90].n_pieces is None and found[90].lossless is None
    assert all(r.lossless for k, r in found.items() if k != 90)
    ids = ls.encode(F.col("text"), F.col("doc_id"))
    again = {r.doc_id: r.ids for r in frame.coalesce(1).select("doc_id", ids.alias("ids")).collect()}
    assert {k: r.ids_crc32 for k, r in found.items()} == {
        k: None if b is None else zlib.crc32(b) for k, b in again.items()
    }
    assert ls.digest(frame.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query(spark):
    from nomenlink.llm.queries import op9_lattice_sampling

    rows = op9_lattice_sampling(spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.lossless and r.n_pieces > 0 for r in rows)
