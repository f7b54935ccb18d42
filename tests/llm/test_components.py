"""Components against a plain search, on stars, chains, cycles and random links."""

import random

import pytest

from nomenlink.llm.components import components


def plain(links):
    part = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            part.setdefault(a, a)
            part.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in part and b in part and part[a] != part[b] and a != b:
                part[a] = part[b] = min(part[a], part[b])
                changed = True
    return part


CASES = [
    [],
    [(1, 1), (None, 2), (3, None)],
    [(i, i + 1) for i in range(40)],
    [(i, (i + 1) % 12) for i in range(12)] + [(20, 21), (21, 20), (20, 21)],
    [(9, i) for i in range(10, 60)] + [(5, i) for i in range(50, 70)],
    [(random.Random(3).randrange(300), random.Random(i).randrange(300)) for i in range(200)],
]


@pytest.mark.parametrize("links", CASES)
def test_components(spark, links):
    frame = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.component for r in components(frame).collect()} == plain(links)


def test_binary_nodes(spark):
    links = [(b"b", b"a"), (b"c", b"b"), (b"z", b"y")]
    rows = components(spark.createDataFrame(links, "a binary, b binary")).collect()
    assert {bytes(r.node): bytes(r.component) for r in rows} == plain(links)
