"""Attributed tokens against the tokenizer's own offsets."""

import os
import random

import numpy as np
import pytest

from nomenlink.llm import token_attribution as ta
from nomenlink.llm.vocabularies import byte_bpe, encode_ids

FOLDER = "/root/testdata/sf0.001"
TEXTS = ["", "a", "\n", "\n\n", "a\n", "one line\nand another.\n\nx", "日本語\n😀😀 é\n", "a\n\n\nb  \n  c", "<|endoftext|>\nx"]


def by_bytes(text, starts, rule):
    """Counts per section by walking over every byte of every token."""
    lengths = ta.token_lengths()
    section = []
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)])):
        section += [k] * len(text[a:b].encode())
    counts, crossing = [0] * len(starts), [0] * len(starts)
    at = 0
    for i in encode_ids([text])[0]:
        own = section[at : at + lengths[i]]
        at += lengths[i]
        if rule == "most":
            to = max(dict.fromkeys(own), key=own.count)
        else:
            to = own[0] if rule == "first" else own[-1]
        counts[to] += 1
        crossing[to] += own[0] != own[-1]
    assert at == len(section)
    return counts, crossing


@pytest.mark.parametrize("rule", ta.RULES)
def test_counts_equal_a_walk_over_bytes(rule):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choices("ab \n.é日", k=80)) for _ in range(200)]
    for text in texts:
        for starts in (ta.line_starts(text), ta.paragraph_starts(text)):
            ends, tokens, crossing = ta.section_counts(text, encode_ids([text])[0], starts, rule)
            assert (tokens.tolist(), crossing.tolist()) == by_bytes(text, starts, rule)
            assert ends[-1] == len(text) and starts == sorted(set(starts))


def test_byte_spans_agree_with_character_offsets():
    text = "Plain words, numbers 123 and\nlines."
    found = byte_bpe().encode(text, add_special_tokens=False)
    ends = np.cumsum(ta.token_lengths()[found.ids])
    assert [b for _, b in found.offsets] == ends.tolist()


def test_sections_of_documents(spark):
    rows = [(i, t, 3) for i, t in enumerate(TEXTS)] + [(50, None, 3), (None, "a\nb", 3), (1, "a", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, section int")
    found = ta.count_by_section(frame).collect()
    totals = {}
    for r in found:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.n_tokens
    assert 50 not in totals
    expected = {i: len(byte_bpe().encode(t, add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    assert totals == expected | {None: 3, 1: 2 * expected[1]}
    assert ta.count_by_section(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        ta.count_by_section(frame, rule="none")


def test_fields_share_one_encoding(spark):
    frame = spark.createDataFrame(
        [(1, "Title", "A body text", None), (2, None, "", "x")],
        "doc_id long, title string, body string, note string",
    )
    rows = ta.count_by_field(frame, ("title", "body", "note"), separator="\n").collect()
    for r, text in zip(rows, ["Title\nA body text\n", "\n\nx"]):
        assert sum(r.n_tokens) == len(byte_bpe().encode(text, add_special_tokens=False).ids)
    assert rows[0].n_tokens.asDict() == {"title": 2, "body": 4, "note": 0}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query(spark):
    from nomenlink.llm.queries import op4_token_attribution

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    found = {}
    for r in op4_token_attribution(spark, FOLDER).collect():
        found.setdefault(r.doc_id, {})[r.section] = (r.start, r.end, r.n_tokens, r.n_crossing)
    for d in docs:
        starts = ta.line_starts(d.text)
        tokens, crossing = by_bytes(d.text, starts, "most")
        own = [found[d.doc_id][k] for k in range(len(starts))]
        assert own == list(zip(starts, [*starts[1:], len(d.text)], tokens, crossing))
