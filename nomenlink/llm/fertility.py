"""Quality rules from tokeniser fertility, with bands per language or script.

Two public vocabularies measure a text: word characters per token and token entropy in
the byte-level one, and the share of byte-fallback pieces of its words in the piece one.
The texts of one language (of one script where the language is null) and of like length
(one octave of tokens, as entropy grows and spread shrinks with length) give the quartiles
of each measure; a text outside the band around them is rejected. A few plain counts
reject short and repetitive texts before.

Words are runs without ASCII white space.

Defined results: a null or wordless text has zero counts and null measures and fails the
base rules. A band comes from all distinct texts of its group that pass the base rules, so
copies count once. Each source of enough texts gives quartiles of its own, the smaller
sources share some, and the band is built on the medians of these, so that no single source
moves it; without a column ``source`` all texts are of one. A band has a least width, wider
for few texts, as their quartiles are uncertain; an octave of very few texts, or of fewer
sources than a median needs where the language has more, has the band of its language or
script.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocabularies as voc
from .common import remembered, small_batches, tidy, written

MIN_WORDS = 50
# Percent of the words that may lie in repeated windows.
MAX_REPEAT = 50
# A band reaches so many interquartile ranges beyond the quartiles (the usual outer fence),
REACH = 3.0
# and at least so far from the median,
LEAST = {"chars_per_token": 0.15, "fallback_share": 0.05, "entropy": 0.5}
# of which a group of this many texts adds one more; fewer texts have no band of their own,
# nor fewer texts of a source quartiles of their own.
FEW = 20
# Medians of fewer quartiles than this can be moved by one source.
VOTERS = 3
MEASURES = tuple(LEAST)
# Bands are broadcast up to this number; a language of one's own for every text is not.
MAX_BANDS = 10_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = ", ".join(
    [f"{c} long" for c in COUNTS]
    + [f"{c} double" for c in MEASURES]
    + ["script string", "octave int"]
)


def repeated_windows(words: np.ndarray, distinct: int) -> int:
    """Number of words inside a three-word window that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    first = words[:-2].astype(np.int64) * distinct + words[1:-1]
    _, first = np.unique(first, return_inverse=True)
    _, at, seen = np.unique(
        first.astype(np.int64) * distinct + words[2:], return_inverse=True, return_counts=True
    )
    start = seen[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= start
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return len(lines) - len(set(lines))


def main_script(letters: dict[str, int]) -> str:
    """The script of most letters by the first word of their names; ties by name."""
    found: dict[str, int] = {}
    for c, n in letters.items():
        if c.isalpha():
            script = "LATIN" if c < "ɐ" else unicodedata.name(c, "OTHER").split(" ")[0]
            found[script] = found.get(script, 0) + n
    return min(found, key=lambda s: (-found[s], s)) if found else "NONE"


@remembered
def known_characters(folder: str | None = None) -> frozenset[str]:
    """Characters that are pieces; no text of these alone needs a byte piece."""
    pieces = voc.pieces(folder)
    found = (pieces.id_to_piece(i) for i in range(pieces.get_piece_size()))
    return frozenset(p for p in found if len(p) == 1)


def fallback_share(text: str, words: list[str], folder: str | None = None) -> float:
    """Share of byte pieces among the pieces of the words."""
    if set(text).difference(_BLANKS) <= known_characters(folder):
        return 0.0
    pieces = voc.pieces(folder)
    ids = np.concatenate([np.asarray(x) for x in pieces.encode(words, num_threads=1)])
    # Byte pieces stand right after the three control pieces.
    return float(((ids >= 3) & (ids < 259)).mean())


def measure_text(text: str | None, folder: str | None = None) -> dict:
    """Counts and measures of one text."""
    row: dict = dict.fromkeys(COUNTS, 0) | dict.fromkeys(MEASURES)
    row |= {"script": "NONE", "octave": 0}
    if not text:
        return row
    row["n_symbols"] = sum(map(text.count, _SYMBOLS))
    words = _WORD.findall(text)
    if not words:
        return row
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    tokens = voc.encode_ids([text], folder)[0]
    _, seen = np.unique(tokens, return_counts=True)
    share = seen / len(tokens)
    word_chars = len(text) - sum(map(text.count, _BLANKS))
    return row | {
        "n_words": len(words),
        "word_chars": word_chars,
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeated_windows(ids, len(place)),
        "chars_per_token": row_round(word_chars / len(tokens)),
        "fallback_share": row_round(fallback_share(text, words, folder)),
        "entropy": row_round(-(share * np.log2(share)).sum()),
        "octave": len(tokens).bit_length(),
        "script": script_of(text),
    }


def script_of(text: str) -> str:
    if text.isascii():
        return "LATIN" if any(map(str.isalpha, text)) else "NONE"
    return main_script({c: text.count(c) for c in set(text)})


def row_round(x: float) -> float:
    return round(float(x), 6)


def measured(text: Column, folder: str | None = None) -> Column:
    """A struct of the counts and measures of a text."""
    schema = T.StructType.fromDDL(_SCHEMA)

    @F.pandas_udf(schema)
    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([measure_text(t, folder) for t in batch], columns=schema.names)
            for c in COUNTS:
                out[c] = out[c].astype("int64")
            for c in MEASURES:
                out[c] = out[c].astype("float64")
            out["octave"] = out["octave"].astype("int32")
            yield out

    return run(text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT * n_words)


def _joinable(few: DataFrame) -> DataFrame:
    return F.broadcast(few) if few.count() <= MAX_BANDS else few


def distinct_texts(rows: DataFrame) -> DataFrame:
    """One row per distinct text of a band that passes the base rules.

    ``rows`` has ``band``, ``octave``, ``source``, ``text_key``, ``base_failed`` and the
    measures. A text of several sources goes to one of them, picked by hash so that copied
    texts do not all go to the same.
    """
    good = rows.where(~F.col("base_failed"))
    picked = F.min_by("source", F.xxhash64("source", "text_key")).alias("source")
    return good.groupBy("band", "octave", "text_key", *MEASURES).agg(picked)


def _voters(texts: DataFrame, *keys: str) -> DataFrame:
    """The voter that each source of a group belongs to.

    A source of ``FEW`` texts is one by itself. The smaller ones are dealt by hash to voters
    of about so many texts.
    """
    sources = written(texts.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("of_source")), "sources")
    own = F.col("of_source") >= FEW
    small = F.sum(F.when(own, 0).otherwise(F.col("of_source")))
    parts = sources.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(small / FEW)).alias("parts"))
    dealt = F.concat(F.lit("part "), F.expr("pmod(xxhash64(source), parts)").cast("string"))
    voter = F.when(own, F.concat(F.lit("source "), "source")).otherwise(dealt)
    return sources.join(parts, list(keys)).select(*keys, "source", voter.alias("voter"))


def bands(texts: DataFrame, *keys: str) -> DataFrame:
    """Per group the lowest and highest accepted value of each measure, its size ``n``, and
    its number of ``voters``.

    ``texts`` has the keys, ``source`` and the measures, one row per distinct text. The
    quartiles come from mergeable sketches, so a language of any size is never gathered.
    """
    voters = written(_voters(texts, *keys), "voters")
    votes = texts.join(_joinable(voters), [*keys, "source"]).groupBy(*keys, "voter")
    votes = votes.agg(
        F.count(F.lit(1)).alias("n"),
        *(F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias(c) for c in MEASURES),
    )
    # The quartiles of a handful of texts only count where the group has no more.
    sure = F.col("n") >= FEW // 2
    size = F.sum("n").alias("n")
    sure_votes = F.sum(sure.cast("int")).alias("voters")
    places = [(c, i) for c in MEASURES for i in range(3)]
    # Nulls do not count; the second of each pair serves groups without a sure vote.
    mids = [F.percentile_approx(F.when(sure, F.col(c)[i]), 0.5, 10_000).alias(f"{c}_{i}") for c, i in places]
    rest = [F.percentile_approx(F.col(c)[i], 0.5, 10_000).alias(f"{c}_{i}_any") for c, i in places]
    quartiles = votes.groupBy(*keys).agg(size, sure_votes, *mids, *rest)
    edges = []
    for c in MEASURES:
        low, mid, high = (
            F.when(F.col("voters") > 0, F.col(f"{c}_{i}")).otherwise(F.col(f"{c}_{i}_any")) for i in range(3)
        )
        reach = REACH * (high - low)
        least = LEAST[c] * (1 + FEW / F.col("n"))
        edges += [
            F.least(low - reach, mid - least).alias(f"{c}_low"),
            F.greatest(high + reach, mid + least).alias(f"{c}_high"),
        ]
    return quartiles.select(*keys, "n", "voters", *edges)


def _limits(rows: DataFrame) -> DataFrame:
    """Bands by language or script and octave; octaves of few texts have the band of all."""
    texts = written(distinct_texts(rows), "texts")
    of_all = written(bands(texts, "band").drop("n"), "bands")
    own = bands(texts, "band", "octave").where(F.col("n") >= FEW).drop("n")
    edges = [c for c in own.columns if c not in ("band", "octave", "voters")]
    # An octave of one or two sources tells nothing of a language that has more.
    enough = F.least(F.col("voters_of_all"), F.lit(VOTERS))
    own = own.join(of_all.select("band", F.col("voters").alias("voters_of_all")), "band")
    own = own.where(F.col("voters") >= enough).drop("voters", "voters_of_all")
    of_all = of_all.drop("voters")
    octaves = texts.select("band", "octave").distinct()
    joined = octaves.join(own, ["band", "octave"], "left")
    joined = joined.join(of_all.withColumnsRenamed({c: f"all_{c}" for c in edges}), "band")
    return joined.select(
        F.col("band").alias("_band"),
        F.col("octave").alias("_octave"),
        *(F.coalesce(c, f"all_{c}").alias(c) for c in edges),
    )


def _judged(docs: DataFrame, folder: str | None, *columns: Column | str) -> DataFrame:
    """The given columns with band, measures and verdict of every document.

    The measures are written once, as the bands and the verdicts both read them.
    """
    small_batches(docs.sparkSession)
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit("")
    found = docs.select(
        F.struct(*columns).alias("given"),
        "lang",
        F.coalesce(source, F.lit("")).alias("source"),
        F.xxhash64("text").alias("text_key"),
        measured(F.col("text"), folder).alias("found"),
    )
    rows = found.select("*", F.coalesce("lang", "found.script").alias("band"), "found.*")
    rows = written(rows.drop("found", "lang"), "measured")
    rows = rows.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    limits = written(_limits(rows), "bands")
    inside = F.lit(True)
    for c in MEASURES:
        inside &= F.col(c).between(F.col(f"{c}_low"), F.col(f"{c}_high"))
    same = (F.col("band") == F.col("_band")) & (F.col("octave") == F.col("_octave"))
    # A few dozen rows per language or script, whatever the number of documents.
    joined = rows.drop("source", "text_key").join(_joinable(limits), same, "left")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return joined.withColumn("kept", kept).select("given.*", *(c for c in joined.columns if c != "given"), "kept")


def judge(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """``doc_id``, counts, ``base_failed``, ``kept``, measures and ``band`` of every document.

    ``docs`` has doc_id, text and lang.
    """
    found = _judged(docs, folder, "doc_id")
    return found.select("doc_id", *COUNTS, "base_failed", "kept", *MEASURES, "band")


def filter_documents(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    # The columns travel in a struct, so that no name can clash.
    row = F.struct(*docs.columns).alias("row")
    return _judged(docs, folder, row).where("kept").select("row.*")
