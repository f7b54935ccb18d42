"""Counts against a plain form, and bands on planted texts."""

import math
import os
import random
import re
from collections import Counter

import pytest

from nomenlink.llm import fertility as fe
from nomenlink.llm.vocabularies import byte_bpe, pieces

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t", "one", "a b c a b c", "a b a b a b a", "x\nx\n \n \ny\nx", "# $ | ** <>%&",
    "no\u00a0break\u2003space \x85 \x1c", "日本語 日本語 日本語 日本語", "😀 naïve ☃ text", "a" * 50_000,
    ("w " * 30_000).strip(), "l1 l2 l3\n" * 40,
]


def plain(text):
    """All counts and measures by their definitions."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    inside = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    out = {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(inside),
    }
    if words:
        ids = byte_bpe().encode(text, add_special_tokens=False).ids
        share = [n / len(ids) for n in Counter(ids).values()]
        sp = [i for w in words for i in pieces().encode(w)]
        out |= {
            "chars_per_token": out["word_chars"] / len(ids),
            "fallback_share": sum(pieces().is_byte(i) for i in sp) / len(sp),
            "entropy": -sum(p * math.log2(p) for p in share),
        }
    return out


def same(row, expected):
    for name in (*fe.COUNTS, *fe.MEASURES):
        value = expected.get(name)
        assert row[name] == (None if value is None else pytest.approx(value, abs=2e-6)), name


@pytest.mark.parametrize("text", TEXTS + ["".join(random.Random(i).choices("ab \n#é", k=300)) for i in range(20)])
def test_measures_equal_the_plain_form(text):
    same(fe.measure_text(text), plain(text))


def test_scripts():
    found = [fe.measure_text(t)["script"] for t in ("abc", "Привет мир", "日本 日本", "123", "été", None)]
    assert found == ["LATIN", "CYRILLIC", "CJK", "NONE", "LATIN", "NONE"]


def texts_of(n, seed=1):
    rng = random.Random(seed)
    words = "the and of house water walking under light people river morning story little garden".split()
    return [" ".join(rng.choices(words, k=rng.randint(80, 400))) for _ in range(n)]


def test_bands_reject_odd_texts_and_keep_the_others(spark):
    good = [(i, t, "en", 1) for i, t in enumerate(texts_of(200))]
    odd = [(900, " ".join(f"q{chr(97 + i % 26)}x{i}zk" for i in range(300)), "en", 1)]
    short = [(901, "too few words", "en", 1), (902, None, None, 1), (None, texts_of(1)[0], "en", 1)]
    few = [(903, texts_of(1, 5)[0], "xx", 1), (904, texts_of(1, 6)[0], None, 1)]
    frame = spark.createDataFrame(good + odd + short + few, "doc_id long, text string, lang string, kept int")
    rows = {r.doc_id: r for r in fe.judge(frame).collect()}
    assert all(rows[i].kept for i, *_ in good) and rows[None].kept
    assert not rows[900].kept and not rows[900].base_failed
    assert not any(rows[i].kept for i in (901, 902)) and rows[901].base_failed
    assert rows[903].kept and rows[904].kept and rows[904].band == "LATIN"
    left = fe.filter_documents(frame)
    assert left.columns == frame.columns
    assert {r.doc_id for r in left.collect()} == {i for i, r in rows.items() if r.kept}


def odd_text(i):
    return " ".join(f"q{chr(97 + (i + j) % 26)}x{j}zk" for j in range(100 + i))


@pytest.mark.parametrize("copies", [True, False])
def test_a_third_of_bad_rows_moves_no_band(spark, copies):
    """The bad rows are copies of a few texts in all sources, or all differ and have one source."""
    good = [(i, t, "en", f"src{i % 10}") for i, t in enumerate(texts_of(400))]
    bad = [
        (1000 + i, odd_text(i % 5 if copies else i), "en", f"src{i % 10}" if copies else "src3")
        for i in range(200)
    ]
    frame = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    rows = fe.judge(frame).collect()
    assert len(rows) == 600 and not any(r.base_failed for r in rows)
    kept = {r.doc_id for r in rows if r.kept}
    assert not kept & {i for i, *_ in bad}
    # A fence of three ranges may lose the ends of short texts.
    assert len(kept) >= 0.99 * len(good)


def test_many_bands_join_without_broadcast(spark, monkeypatch):
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts_of(30))], "doc_id long, text string, lang string")
    first = sorted(map(tuple, fe.judge(frame).collect()))
    monkeypatch.setattr(fe, "MAX_BANDS", 0)
    assert sorted(map(tuple, fe.judge(frame).collect())) == first


def test_empty_table(spark):
    assert fe.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query(spark):
    from nomenlink.llm.queries import op3_fertility

    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = op3_fertility(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        same(r, plain(docs[r.doc_id].text))
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
        assert failed or r.kept or labels.get(r.doc_id) != 1
