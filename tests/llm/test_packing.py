"""Packing against exhaustive search and the tokenizer itself."""

import os
import random
import zlib

import numpy as np
import pytest

from nomenlink.llm import packing
from nomenlink.llm.vocabularies import byte_bpe, encode_ids

FOLDER = "/root/testdata/sf0.001"


def fewest(items, capacity):
    """The optimum by trying every place for every item."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        tried = set()
        for j, used in enumerate(bins):
            if used + items[i] <= capacity and used not in tried:
                tried.add(used)
                bins[j] += items[i]
                place(i + 1, bins)
                bins[j] -= items[i]
        bins.append(items[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_small_packings_are_optimal(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 23, 100])
    low, high = (1, capacity) if seed % 2 else (capacity // 5, capacity // 2 + 2)
    items = [rng.randint(low, high) for _ in range(rng.randint(1, 10))]
    counts = {x: items.count(x) for x in items}
    found = packing.pack_lengths(counts, capacity)
    used = {}
    for use in found.uses:
        assert sum(x * k for x, k in use.filling) <= capacity
        for x, k in use.filling:
            used[x] = used.get(x, 0) + k * use.times
    assert used == counts
    best = fewest(items, capacity)
    assert found.lower_bound <= best == found.sequences


def test_search_beats_best_fit():
    counts = {6: 1, 5: 1, 4: 2, 3: 2, 2: 0}
    assert packing.pack_lengths(counts, 12).sequences == 3
    # Best-fit decreasing needs four here.
    hard = {7: 2, 6: 2, 4: 2, 3: 2}
    assert packing.pack_lengths(hard, 10).sequences == 4
    assert packing.pack_lengths({}, 10) == packing.Packing([], 0, 0)
    with pytest.raises(ValueError):
        packing.pack_lengths({11: 1}, 10)


def test_many_pieces_reach_the_lower_bound_closely():
    rng = np.random.default_rng(5)
    lengths = np.clip(rng.lognormal(6, 1, 200_000), 1, 2048).astype(int)
    counts = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True))}
    found = packing.pack_lengths(counts)
    assert found.sequences <= found.lower_bound * 1.001 + 1


def test_cut():
    assert packing.cut(5, 10) == [(0, 5)]
    assert packing.cut(10, 10) == [(0, 10)]
    assert packing.cut(23, 10) == [(0, 3), (3, 10), (13, 10)]
    assert packing.cut(30, 10) == [(0, 10), (10, 10), (20, 10)]


def test_fast_ids_equal_the_tokenizer():
    rng = random.Random(3)
    alphabet = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xA1, 0x180))]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choices(" \n\t'a1.é", k=30)) for _ in range(3000)]
    texts += ["", "<|endoftext|>", "a<|endoftext|>b", "日本語 text", "a b\x1c", "😀 x", "  " * 500]
    expected = [byte_bpe().encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encode_ids(texts)] == expected


def check_whole(docs, rows, capacity):
    """Every document is cut and packed whole, without gaps or overlaps."""
    by_sequence = {}
    pieces = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    expected = {}
    for doc_id, text in docs:
        ids = byte_bpe().encode(text or "", add_special_tokens=False).ids + [0]
        own = [
            (i, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()))
            for i, (a, n) in enumerate(packing.cut(len(ids), capacity))
        ]
        expected.setdefault(doc_id, []).extend(own)
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in expected.items()}


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "word " * 700), (4, "word " * 700), (4, "word " * 700), (None, "x")]
    frame = spark.createDataFrame([(*d, 7, "z") for d in docs], "doc_id long, text string, piece int, length string")
    rows = packing.pack(frame, capacity=64).collect()
    check_whole(docs, rows, 64)
    assert packing.pack(frame.limit(0), capacity=64).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query(spark):
    from nomenlink.llm.queries import op10_packing

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    check_whole(docs, op10_packing(spark, FOLDER).collect(), 2048)
