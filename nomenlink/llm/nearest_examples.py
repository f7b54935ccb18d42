"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine.

* Terms are lower-cased words and the leading 3 to 6 characters of longer ones (so that
  inflected forms of a word meet). The vocabulary has the terms whose share differs between
  the classes of the examples beyond chance: those with a log-likelihood ratio that one
  random term among all would exceed with probability 0.05 at most. Other terms
  would only dilute the cosine of a long text.
* Document frequencies of the vocabulary are counted over all documents. A weight is the
  logarithm of one more than the count, times the inverse document frequency.
* The index holds the examples in blocks of similar ones, and per term and block the
  largest weight. A text's bound for a block is the product of its weights with
  those maxima. Blocks are scored, best first, while their bound reaches the score of
  the text's ``NEIGHBOURS``-th best example; the others cannot hold one of its neighbours.
* All examples as near as the ``NEIGHBOURS``-th vote, weighted by the inverse square of
  their distance, less that at distance one; so an example without a common term has no
  vote. The toxic share of all labelled documents votes as well, with the weight of as many
  examples at distance one half. A logistic curve, fitted on the votes that each example
  gets from the others and weighted to that share, turns the vote into a score. The
  neighbours are the evidence.

Examples are a bounded sample (``EXAMPLES``, half of each class as far as there are so
many) of the labelled documents that may be learnt from. Of near copies of a class one is
an example: those that share the least hash of their runs of five words under any of four
hash functions. Otherwise any word of a text that was copied often would look like a sign
of its label. Every document is scored on its whole text.

Defined results: a null or empty text, and one without a term of the vocabulary, is as near
to each example without one as to any other: they all vote alike. A label other than 0 and 1 says
nothing; an id labelled both ways counts as toxic; of rows that repeat an id the text of
lowest hash is the example. Without examples of both classes, or where no term tells them
apart, every score is the share of toxic labels (0 without any). Ties all vote.
Repeated rows get equal scores. An empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, small_batches, tidy, written

# The bounds of the sample of examples and of the vocabulary.
EXAMPLES = 8000
TERMS = 4096
NEIGHBOURS = 15
THRESHOLD = 0.5
# Examples of one block of the index.
BLOCK = 64
LEADING = (3, 4, 5, 6)
# Probability that any term at all enters the vocabulary by chance.
CHANCE = 0.05
# Added to distances, so that an equal example weighs much and not all.
SOFT = 0.05
# Words of a run, and hash functions, that tell near copies.
RUN, HASHES = 5, 4
# Similarities closer than this are equal.
EQUAL = 1e-9
_PIECE = 1 << 20
_WORD = re.compile(r"[^\W_]+")


def terms_of(word: str) -> list[str]:
    """The terms of a word: itself, and what it starts with, marked by a hyphen."""
    return [word, *(f"{word[:n]}-" for n in LEADING if n < len(word))]


def words(text: str | None) -> Counter:
    """How often each lower-cased word is in a text, read in pieces that end between words."""
    found: Counter = Counter()
    text = text or ""
    at = 0
    while at < len(text):
        end = at + _PIECE
        if end < len(text):
            gap = re.compile(r"[\W_]").search(text, end)
            end = gap.start() if gap else len(text)
        found.update(_WORD.findall(text[at:end].lower()))
        at = end
    return found


class Vocabulary:
    """Numbers of the terms, and the counts of a text's terms."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __len__(self) -> int:
        return len(self.number)

    def count(self, text: str | None) -> dict[int, int]:
        out: dict[int, int] = {}
        known, number = self.known, self.number
        if len(known) > 200_000:
            known.clear()
        for word, n in words(text).items():
            mine = known.get(word)
            if mine is None:
                mine = tuple(number[t] for t in terms_of(word) if t in number)
                known[word] = mine
            for t in mine:
                out[t] = out.get(t, 0) + n
        return out


def run_hashes(text: str) -> list[int]:
    """The least hash of the text's runs of words, under each of some hash functions.

    A text of fewer words is one run.
    """
    mine = text.split()
    runs = {" ".join(mine[i : i + RUN]) for i in range(max(1, len(mine) - RUN + 1))}
    own = np.array([xxhash.xxh64_intdigest(r) for r in runs], np.uint64)
    return [int(mix64(own ^ np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)).min() >> np.uint64(1)) for i in range(1, HASHES + 1)]


class Index(NamedTuple):
    """Examples in blocks, with the largest weight of every term in each.

    ``weights[b]`` has a row for each of ``terms[b]`` and a column for each example of
    block ``b``; ``most`` has a row per term and a column per block.
    """

    idf: np.ndarray
    ids: list
    labels: np.ndarray
    empty: np.ndarray
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    most: np.ndarray


def unit_weights(counts: list[dict[int, int]], idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length one, a row per text; zero for a text without terms."""
    out = np.zeros((len(counts), len(idf)))
    for row, mine in zip(out, counts):
        if mine:
            at = np.fromiter(mine.keys(), np.int64, len(mine))
            n = np.fromiter(mine.values(), np.float64, len(mine))
            row[at] = np.log1p(n) * idf[at]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-300)


def build_index(ids: list, labels: np.ndarray, counts: list[dict[int, int]], idf: np.ndarray) -> Index:
    """Put examples that share their heaviest terms into the same blocks."""
    n_terms = len(idf)
    # Dense rows for one block of examples at a time, never for all.
    def heaviest(mine: dict[int, int]) -> tuple:
        order = sorted(mine, key=lambda t: (-np.log1p(mine[t]) * idf[t], t))
        return (not mine, order[:4])

    order = sorted(range(len(ids)), key=lambda i: (heaviest(counts[i]), labels[i], str(ids[i])))
    full = [i for i in order if counts[i]]
    empty = [i for i in order if not counts[i]]
    terms, weights = [], []
    most = np.zeros((n_terms, -(-len(full) // BLOCK)))
    for b in range(most.shape[1]):
        block = unit_weights([counts[i] for i in full[b * BLOCK : (b + 1) * BLOCK]], idf)
        used = np.flatnonzero(block.any(0))
        terms.append(used)
        weights.append(np.ascontiguousarray(block[:, used].T))
        most[used, b] = block[:, used].max(0)
    return Index(
        idf,
        [ids[i] for i in full] + [ids[i] for i in empty],
        labels[full].astype(float),
        labels[empty].astype(float),
        terms,
        weights,
        most,
    )


def similarities(index: Index, queries: np.ndarray, k: int, skip: np.ndarray | None = None) -> np.ndarray:
    """Cosines of each query to the examples, -1 where a block cannot hold a neighbour.

    Every example as near as the ``k``-th nearest has its exact cosine. ``skip`` names an
    example for each query that is left out.
    """
    n = len(index.labels)
    found = np.full((len(queries), n), -1.0)
    if not n:
        return found
    bounds = queries @ index.most
    reach = np.zeros(len(queries))
    best = bounds.argmax(1)

    def score(block: int, rows: np.ndarray) -> None:
        low = block * BLOCK
        part = queries[np.ix_(rows, index.terms[block])] @ index.weights[block]
        found[rows, low : low + part.shape[1]] = part
        if skip is not None:
            mine = (skip[rows] >= low) & (skip[rows] < low + part.shape[1])
            found[rows[mine], skip[rows[mine]]] = -1.0
        if n > k:
            reach[rows] = np.maximum(0, -np.partition(-found[rows], k - 1, 1)[:, k - 1])

    for block in np.unique(best):
        score(block, np.flatnonzero((best == block) & (bounds[:, block] > 0)))
    done = best
    for block in np.argsort(-bounds.max(0), kind="stable"):
        rows = np.flatnonzero(
            (bounds[:, block] > 0) & (bounds[:, block] >= reach - 2 * EQUAL) & (done != block)
        )
        if len(rows):
            score(block, rows)
    return found


def vote_weight(distance: np.ndarray | float) -> np.ndarray | float:
    """Of an example at a distance of 0 to 1."""
    return 1 / (distance + SOFT) ** 2 - 1 / (1 + SOFT) ** 2


def votes(
    index: Index, queries: np.ndarray, k: int, prior: float, skip: np.ndarray | None = None
) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """For each query the share of toxic votes, and its neighbours with their cosines."""
    found = similarities(index, queries, k, skip)
    n = found.shape[1]
    share = np.zeros(len(queries))
    near = []
    none = float(index.empty.mean()) if len(index.empty) else prior
    base = k * vote_weight(0.5)
    for i, row in enumerate(found):
        if not queries[i].any():
            share[i] = none
            near.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        limit = -np.partition(-row, k - 1)[k - 1] if n > k else 0.0
        mine = np.flatnonzero((row >= limit - EQUAL) & (row > 0))
        weight = vote_weight(1 - np.minimum(row[mine], 1))
        share[i] = ((weight * index.labels[mine]).sum() + base * prior) / (weight.sum() + base)
        near.append((mine, row[mine]))
    return share, near


class Model(NamedTuple):
    terms: list[str]
    index: Index
    slope: float
    offset: float
    prior: float
    neighbours: int


def _logit(share: np.ndarray) -> np.ndarray:
    return np.log((share + 0.02) / (1.02 - share))


def calibrate(share: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Newton steps of a ridge logistic fit from the vote to the label.

    Without a rising curve the offset alone is fitted.
    """
    x = np.stack([_logit(share), np.ones(len(share))], 1)
    for columns in ([0, 1], [1]):
        w, z = np.zeros(2), x[:, columns]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(len(columns))
            w[columns] += np.linalg.solve(h, z.T @ (weight * (labels - p)) - 0.01 * w[columns])
        if w[0] > 0:
            break
    return float(w[0]), float(w[1])


def scores(model: Model, share: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * _logit(share) + model.offset, -30, 30)))


def id_remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def is_held_out(doc_id: Column) -> Column:
    """True where the CRC-32 of the id as text is a multiple of 5; a null id is not."""
    return F.coalesce(id_remainder(doc_id) == 0, F.lit(False))


def _examples(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, float]:
    """The sample as ``doc_id, text, toxic``, written, and the share of toxic ids in all."""
    spark = docs.sparkSession
    learn = F.coalesce(id_remainder(F.col("doc_id")) != 0, F.lit(False))
    known = labels.where(F.col("toxic").isin(0, 1) & learn)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    # An id that many rows share is one row before it meets the labels.
    known = written(known.join(own.select("doc_id").distinct(), "doc_id", "left_semi"), "known")
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = [
        known.where(F.col("toxic") == t).orderBy(*by_hash).limit(most // 2) for t in (0, 1)
    ]
    # The broadcast is bounded by the sample.
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    sample = own.join(ids, "doc_id").groupBy("doc_id", "toxic")
    sample = sample.agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    @F.pandas_udf("array<long>")
    @tidy
    def least(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([run_hashes(text) for text in batch])

    hashed = written(sample.withColumn("least", least("text")), "sample")
    # No group is larger than the sample.
    first = [
        F.min("doc_id").over(Window.partitionBy("toxic", F.get("least", F.lit(i))))
        for i in range(HASHES)
    ]
    alone = hashed.withColumn("first", F.array(*first)).where(
        F.forall("first", lambda i: i == F.col("doc_id"))
    )
    return written(alone.select("doc_id", "text", "toxic"), "examples"), share


def _vocabulary(sample: DataFrame, most: int) -> list[str]:
    """The terms that tell the classes apart, by falling log-likelihood ratio."""
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return []

    @tidy
    def of_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"]):
                mine = list({t for w in words(text) for t in terms_of(w)})
                yield pd.DataFrame({"term": mine, "toxic": toxic})

    found = sample.select("toxic", "text").mapInPandas(of_texts, "term string, toxic int")
    counts = found.groupBy("term").agg(
        F.sum("toxic").alias("k1"), F.count(F.lit(1)).alias("k")
    )
    counts = written(counts, "terms")
    n0, n1 = float(sizes[0]), float(sizes[1])

    def part(k: Column, n: float) -> Column:
        """Log-likelihood of k of n at the overall share, against at its own share."""
        p = F.col("k") / (n0 + n1)

        def times(a: Column, b: Column) -> Column:
            return F.when(a > 0, a * F.log(a / b)).otherwise(0.0)

        return times(k, p * n) + times(F.lit(n) - k, (1 - p) * n)

    ratio = 2 * (part(F.col("k1"), n1) + part(F.col("k") - F.col("k1"), n0))
    # A ratio of x or more has a probability of exp(-x / 2) at most, for each of all terms.
    limit = 2 * float(np.log(max(counts.count(), 1) / CHANCE))
    scored = counts.select("term", ratio.alias("ratio")).where(F.col("ratio") >= limit)
    rows = scored.orderBy(F.desc("ratio"), "term").limit(most).collect()
    return [r.term for r in rows]


def count_terms(docs: DataFrame, terms: list[str]) -> DataFrame:
    """The documents' ``row`` struct with ``terms, counts`` of their texts, written once."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<terms:array<int>,counts:array<int>>")
    @tidy
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(terms)
        for batch in batches:
            mine = [vocabulary.count(text) for text in batch]
            yield pd.DataFrame(
                {"terms": [list(m) for m in mine], "counts": [list(m.values()) for m in mine]}
            )

    counted = docs.withColumn("_found", count(F.col("text")))
    kept = [c for c in docs.columns if c != "text"]
    return written(counted.select(*kept, "_found.terms", "_found.counts"), "counts")


def train(
    docs: DataFrame,
    labels: DataFrame,
    examples: int = EXAMPLES,
    terms: int = TERMS,
    neighbours: int = NEIGHBOURS,
) -> tuple[Model, DataFrame]:
    """The model, and the term counts of all documents by ``doc_id`` that it took.

    The driver gets ``examples`` rows of at most ``terms`` numbers.
    """
    sample, share = _examples(docs, labels, examples)
    vocabulary = _vocabulary(sample, terms)
    counted = count_terms(docs.select("doc_id", "text"), vocabulary)
    frequency = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    df = np.zeros(len(vocabulary))
    for r in frequency:
        df[r.term] = r["count"]
    idf = np.log1p(counted.count() / np.maximum(df, 1))
    rows = count_terms(sample, vocabulary).collect()
    rows.sort(key=lambda r: str(r.doc_id))
    labels_of = np.array([r.toxic for r in rows], np.int64)
    index = build_index(
        [r.doc_id for r in rows], labels_of, [dict(zip(r.terms, r.counts)) for r in rows], idf
    )
    even = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    model = Model(vocabulary, index, 0.0, even, share, neighbours)
    if not len(index.labels):
        return model, counted
    slope, offset = calibrate(*_own_votes(index, rows, share, neighbours))
    return model._replace(slope=slope, offset=offset), counted


def _own_votes(index: Index, rows: list, share: float, k: int):
    """What the other examples say of each, its label, and the weight of its class."""
    by_id = {r.doc_id: dict(zip(r.terms, r.counts)) for r in rows}
    n = len(index.labels)
    said = []
    for low in range(0, n, BLOCK):
        ids = index.ids[low : min(low + BLOCK, n)]
        queries = unit_weights([by_id[i] for i in ids], index.idf)
        said.append(votes(index, queries, k, share, np.arange(low, low + len(ids)))[0])
    if len(index.empty):
        said.append(np.full(len(index.empty), index.empty.mean()))
    labels = np.concatenate([index.labels, index.empty])
    of_class = np.array([1 - share, share]) / np.maximum(np.bincount(labels.astype(int), minlength=2), 1)
    return np.concatenate(said), labels, of_class[labels.astype(int)] * len(labels)


def score_counts(counted: DataFrame, model: Model, evidence: bool = False) -> DataFrame:
    """``doc_id, score`` from term counts; with ``evidence`` also the neighbours.

    Evidence is a list of ``example, toxic, similarity``, nearest first; the example is its
    ``doc_id`` as text.
    """
    spark = counted.sparkSession
    # As large as the sample and the vocabulary allow.
    shared = spark.sparkContext.broadcast(model)
    kind = "struct<score:double"
    if evidence:
        kind += ",evidence:array<struct<example:string,toxic:int,similarity:double>>"

    @F.pandas_udf(kind + ">")
    @tidy
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        mine = shared.value
        for terms, counts in batches:
            shares, near = [], []
            for low in range(0, len(terms), 256):
                some = slice(low, low + 256)
                held = [dict(zip(t, c)) for t, c in zip(terms[some], counts[some])]
                queries = unit_weights(held, mine.index.idf)
                share, found = votes(mine.index, queries, mine.neighbours, mine.prior)
                shares.append(share)
                if evidence:
                    near += found
            share = np.concatenate(shares) if shares else np.zeros(0)
            out = {"score": scores(mine, share)}
            if evidence:
                out["evidence"] = [
                    [
                        {
                            "example": str(mine.index.ids[i]),
                            "toxic": int(mine.index.labels[i]),
                            "similarity": float(s),
                        }
                        for s, i in sorted(zip(-similar, who.tolist()))
                        for s in [-s]
                    ]
                    for who, similar in near
                ]
            yield pd.DataFrame(out)

    made = counted.withColumn("_made", score("terms", "counts"))
    return made.select("doc_id", "_made.*")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model, counted = train(docs, labels)
    scored = score_counts(counted, model)
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
