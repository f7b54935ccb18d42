"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (one to ``LONGEST`` characters, of lower-cased
words with a blank on each side) in order of their counts, equal counts in the order of
their length and characters. A word is a letter and the letters and combining marks, such
as vowel signs, that follow it. A language's profile comes from all its training
texts. A document's n-grams are compared with each profile by the out-of-place distance:
how far the rank of an n-gram differs, summed over the document's profile; an n-gram that
a profile lacks counts as ``PROFILE`` places. The language of least distance wins; equal
distances go to the first by name.

The score is the margin: one minus the ratio of the least distance to the second least,
and 1 where only one language was learned.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is
every text where nothing was learned. Words of any length count whole. Texts of a null
language teach nothing. Letters of all planes count. Of more than ``LANGUAGES`` languages
those with the most training texts are learned, which bounds the profiles that workers get
(``lang`` is free text). Repeated rows teach as often as they stand and get equal answers;
other columns are dropped.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import is_held_out, may_learn, small_batches, tidy

# An n-gram is a number of 21 bits per character, so three are the most.
LONGEST = 3
PROFILE = 400
# Languages that are learned at most; each sends its profile to the driver and workers.
LANGUAGES = 2000
# Distinct n-grams that a worker holds before it passes them on.
HELD = 2_000_000

UNKNOWN = "und"

_PLANE = 0x10000
# Stands for a blank. It sorts before all letters, and no n-gram starts with a zero.
_BLANK = 1
_OTHER, _MARK, _LETTER = range(3)
_KINDS: list[np.ndarray] = []


def _kind(char: str) -> int:
    if char.isalpha():
        return _LETTER
    return _MARK if unicodedata.category(char)[0] == "M" else _OTHER


def _kinds(codes: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter, a combining mark or something else."""
    if not _KINDS:
        _KINDS.append(np.fromiter((_kind(chr(c)) for c in range(_PLANE)), np.uint8, _PLANE))
    kinds = _KINDS[0][np.minimum(codes, _PLANE - 1)]
    beyond = codes >= _PLANE
    if beyond.any():
        different, at = np.unique(codes[beyond], return_inverse=True)
        kinds[beyond] = np.fromiter((_kind(chr(c)) for c in different.tolist()), np.uint8)[at]
    return kinds


def _word_codes(text: str) -> np.ndarray:
    """Code points of the words of the lower-cased text, with a blank around each."""
    raw = f" {text.lower()} ".encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(raw, np.uint32)
    kinds = _kinds(codes)
    # A mark belongs to a word if the last character that is none is a letter.
    base = np.maximum.accumulate(np.where(kinds == _MARK, 0, np.arange(len(codes))))
    inside = kinds[base] == _LETTER
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    keep[0] = True
    return np.where(inside, codes, _BLANK).astype(np.uint64)[keep]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of a text as ascending numbers, and their counts.

    The number has 21 bits per character, so shorter n-grams have lower ones.
    """
    codes = _word_codes(text or "")
    if len(codes) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letter = codes != _BLANK
    grams = [codes[letter]]
    now, inner = codes, None
    for k in range(2, LONGEST + 1):
        now = (now[:-1] << np.uint64(21)) | codes[k - 1 :]
        if k == 2:
            grams.append(now)
            continue
        # Only the ends of an n-gram may be blank.
        last = letter[k - 2 : len(codes) - 1]
        inner = last if inner is None else inner[:-1] & last
        grams.append(now[inner])
    return np.unique(np.concatenate(grams), return_counts=True)


def most_frequent(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The n-grams of highest count, in order; equal counts by the n-gram."""
    if len(grams) > size:
        floor = np.partition(counts, -size)[-size]
        keep = counts >= floor
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:size]


def learn(docs: DataFrame, size: int = PROFILE, most: int = LANGUAGES) -> dict[str, list[int]]:
    """The profile of each language of ``text`` and ``lang``, over all rows.

    Workers count n-grams in bounded memory, Spark adds the counts up, and only the most
    frequent n-grams of each language reach the driver.
    """
    small_batches(docs.sparkSession)

    @tidy
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def told() -> Iterator[pd.DataFrame]:
            for lang, own in held.items():
                grams, at = np.unique(np.concatenate([g for g, _ in own]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in own]), len(grams))
                yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "n": n.astype(np.int64)})

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                found = gram_counts(text)
                held.setdefault(lang, []).append(found)
                size += len(found[0])
            if size > HELD:
                yield from told()
                held, size = {}, 0
        yield from told()

    known = docs.where("lang is not null and text is not null").select("text", "lang")
    texts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).select("lang")
    known = known.join(F.broadcast(texts), "lang", "left_semi").select("text", "lang")
    counted = known.mapInPandas(count, "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Each partition keeps its best first, so that no language meets in one task whole.
    part = F.spark_partition_id().alias("part")
    order = [F.desc("n"), "gram"]
    best = counted.select("*", part)
    best = best.withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    best = best.where(F.col("at") <= size)
    best = best.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    rows = best.where(F.col("at") <= size).select("lang", "gram", "at").collect()
    profiles: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.at)):
        profiles.setdefault(r.lang, []).append(r.gram)
    return profiles


class Matcher:
    """Compares texts with all profiles at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size = size
        self.languages = sorted(profiles)
        lists = [np.array(profiles[name], np.int64).view(np.uint64) for name in self.languages]
        self.known = np.unique(np.concatenate([*lists, np.zeros(1, np.uint64)]))
        # A rank below zero: the profile lacks the n-gram. No n-gram is the number 0.
        self.ranks = np.full((len(self.known), len(lists)), -1, np.int64)
        for i, own in enumerate(lists):
            self.ranks[np.searchsorted(self.known, own), i] = np.arange(len(own))

    def distances(self, text: str | None) -> np.ndarray | None:
        """The distance to each language; null for a text without letters."""
        own = most_frequent(*gram_counts(text), self.size)
        if not len(own):
            return None
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        at[self.known[at] != own] = 0
        ranks = self.ranks[at]
        away = np.abs(ranks - np.arange(len(own))[:, None])
        return np.where(ranks < 0, self.size, away).sum(0)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.distances(text) if self.languages else None
        if found is None:
            return UNKNOWN, 0.0
        best = int(found.argmin())
        if len(found) == 1:
            return self.languages[best], 1.0
        least, second = np.partition(found, 1)[:2]
        score = 1 - float(least) / float(second) if second else 0.0
        return self.languages[best], math.floor(score * 1e6 + 0.5) / 1e6


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document, from its text alone."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(profiles)
        for batch in batches:
            found = [matcher.predict(t) for t in batch]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    out = docs.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), run("text").alias("found")
    )
    return out.select("doc_id", "held_out", "found.*")


def classify(docs: DataFrame) -> DataFrame:
    """Learn from the texts that are not held out, and identify all."""
    return identify(docs, learn(docs.where(may_learn(F.col("doc_id")))))
