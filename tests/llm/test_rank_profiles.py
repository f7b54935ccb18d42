"""Language ID against a plain form, and on held-out documents."""

import math
import os
import random
import zlib
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from nomenlink.llm import rank_profiles as rp

FOLDER = "/root/testdata/sf0.1"


def plain_counts(text):
    """N-grams of lower-cased words with a blank on each side."""
    out = Counter()
    for word in regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower()):
        padded = f" {word} "
        for k in range(1, rp.LONGEST + 1):
            for i in range(len(padded) - k + 1):
                if padded[i : i + k] != " ":
                    out[padded[i : i + k]] += 1
    return out


def name(gram):
    """The characters of an n-gram's number."""
    codes = [(int(gram) >> 21 * k) & 0x1FFFFF for k in (2, 1, 0)]
    return "".join(chr(32 if c == 1 else c) for c in codes if c)


TEXTS = ["", None, "12 !?", "a", "A b-a", "Été à l'école", "ſtraße ßß", "日本 語", "x" * 5000, "हिन्दी में लिखा", "e\u0301te\u0301 \u0301x", "\u0301", "𞤀𞤁 𐐀𐐁a", "ab" * 1_000_000, "the thing then"]


@pytest.mark.parametrize("text", TEXTS)
def test_counts_equal_the_plain_form(text):
    grams, counts = rp.gram_counts(text)
    assert {name(g): n for g, n in zip(grams, counts.tolist())} == plain_counts(text)


def test_letters_beyond_the_basic_plane_are_told_apart():
    assert rp.gram_counts("𐐀𐐁")[1].sum() == 7 and len(rp.gram_counts("😀")[0]) == 0
    chance = random.Random(3)
    words = [["".join(chr(0x1E922 + chance.randrange(b, b + 9)) for _ in range(6)) for _ in range(50)] for b in (0, 12)]
    profiles = {
        lang: rp.most_frequent(*rp.gram_counts(" ".join(own[:40]))).astype("int64").tolist()
        for lang, own in zip("ab", words)
    }
    matcher = rp.Matcher(profiles)
    assert [matcher.predict(" ".join(own[40:]))[0] for own in words] == ["a", "b"]


def test_more_languages_than_are_learned(spark):
    rows = [(i, f"text {chr(97 + i % 7)}x", f"l{i % 7}") for i in range(70)] + [(99, "y", "l0")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(rp.learn(frame, most=3)) == ["l0", "l1", "l2"]


def test_whole_result_equals_the_plain_form(spark):
    """Counts, profiles, distances, ties and scores of all documents, in plain Python."""
    folder = "/root/testdata/sf0.001"
    docs = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    counts = [plain_counts(d["text"]) for d in docs]

    def top(c):
        return sorted(c, key=lambda g: (-c[g], len(g), g))[: rp.PROFILE]

    learned = {}
    for d, c in zip(docs, counts):
        if d["lang"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2:
            learned.setdefault(d["lang"], Counter()).update(c)
    ranks = {lang: {g: i for i, g in enumerate(top(c))} for lang, c in learned.items()}
    expected = []
    for d, c in zip(docs, counts):
        away = sorted(
            (sum(abs(r[g] - i) if g in r else rp.PROFILE for i, g in enumerate(top(c))), lang)
            for lang, r in ranks.items()
        )
        held = zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2
        if not c:
            expected.append((d["doc_id"], held, "und", 0.0))
        else:
            score = 1 - away[0][0] / away[1][0]
            expected.append((d["doc_id"], held, away[0][1], math.floor(score * 1e6 + 0.5) / 1e6))
    from nomenlink.llm.queries import op8_rank_profiles

    assert sorted(map(tuple, op8_rank_profiles(spark, folder).collect())) == sorted(expected)


def test_distance_is_out_of_place():
    profiles = {}
    for lang, text in (("en", "the then them that"), ("de", "der die das dem")):
        profiles[lang] = rp.most_frequent(*rp.gram_counts(text), 10).astype("int64").tolist()
    matcher = rp.Matcher(profiles, 10)
    own = [name(g) for g in rp.most_frequent(*rp.gram_counts("then der"), 10)]
    for i, lang in enumerate(matcher.languages):
        ranks = {name(g): r for r, g in enumerate(profiles[lang])}
        expected = sum(abs(ranks[g] - r) if g in ranks else 10 for r, g in enumerate(own))
        assert matcher.distances("then der")[i] == expected
    assert matcher.predict("them that")[0] == "en" and matcher.predict("5") == ("und", 0.0)


def test_learning_counts_all_rows_but_the_held_out(spark):
    rows = [(i, "the thing they then" if i % 2 else "der dieser den dem", "en" if i % 2 else "de") for i in range(80)]
    rows = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    rows += [(None, "zzz zzz", "zz"), (1001, "the they", None), (1003, None, "de"), (1003, None, "de")]
    frame = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string")
    found = rp.classify(frame).collect()
    assert len(found) == len(rows)
    by_text = {(r.lang_pred) for r in found}
    assert by_text == {"en", "de", "und"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None)
    profiles = rp.learn(frame.where("lang = 'en'"))
    counts = Counter()
    for _, t, lang in rows:
        if lang == "en":
            counts += plain_counts(t)
    order = sorted(counts, key=lambda g: (-counts[g], len(g), g.replace(" ", "\0")))
    assert [name(g) for g in profiles["en"]] == order[: rp.PROFILE]


def test_nothing_learned(spark):
    frame = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in rp.classify(frame).collect()] == ["und"]
    assert rp.classify(frame.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    from nomenlink.llm.queries import op8_rank_profiles

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = op8_rank_profiles(spark, FOLDER).where("held_out").join(docs, "doc_id")
    assert rows.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97
