"""Quality classifier: a linear-chain CRF over the lines of a document.

Every line that holds a word is a position of the chain, in state bad or good. The state
weights see shape features of the line and of its two neighbours; two-by-two transition
weights couple adjacent lines. The document score is the mean of the forward-backward
marginals of "good", weighted by line length, passed through a logistic calibration that
is fitted on the training documents.

Defined results: a null or wordless text has score 0. Labels that are null or other than
0 and 1 teach nothing; contradicting labels of one id count by their mean. Without
labels of both classes all documents have one score, and a filter keeps them all. Lines of any
length and documents of any number of lines are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, may_learn, small_batches, tidy, written

# The bounds of the training sample: labelled documents, lines of all of them, and lines of
# one, so that no long document takes the place of the others.
FIT_ROWS = 6000
FIT_ALL_LINES = 400_000
FIT_OWN_LINES = 4000
# Training cuts long chains into pieces of this many lines; scoring never does.
FIT_LINES = 64
FIT_STEPS = 200
THRESHOLD = 0.7

_SPACE = " \t\n\x0b\x0c\r"
_CLASSES = 8
_LETTER, _UPPER, _DIGIT, _BLANK, _SYMBOL, _SHOUT, _STOP, _OTHER = range(_CLASSES)
_OWN = 20
# Features of a neighbouring line that its two neighbours see too.
_SEEN = [1, 3, 6, 7, 10, 15, 16, 17, 18]
N_FEATURES = _OWN + 2 * (len(_SEEN) + 1)


def _class_table() -> np.ndarray:
    """The character class of each code point of the basic plane."""
    out = np.full(0x10000, _OTHER, np.uint8)
    for cp in range(0x10000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = _UPPER if c.isupper() else _LETTER
        elif c.isdigit():
            out[cp] = _DIGIT
        elif c.isspace():
            out[cp] = _BLANK
    for chars, kind in (("#*$%&|<>", _SYMBOL), ("!?", _SHOUT), (".,;:", _STOP)):
        for c in chars:
            out[ord(c)] = kind
    return out


_TABLE: list[np.ndarray] = []


def _classes(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_class_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[0][np.minimum(points, 0xFFFF)]


class Lines(NamedTuple):
    """The lines of a batch: features, lengths, and the number of lines per text."""

    features: np.ndarray
    lengths: np.ndarray
    per_text: np.ndarray


def line_features(texts: list[str | None]) -> Lines:
    """Features of all lines that hold a word, document after document."""
    lines: list[str] = []
    repeated: list[float] = []
    per_text = np.zeros(len(texts), np.int64)
    for at, text in enumerate(texts):
        seen: set[str] = set()
        own = [x for x in (text or "").split("\n") if x.strip(_SPACE)]
        for line in own:
            repeated.append(float(line in seen))
            seen.add(line)
        lines += own
        per_text[at] = len(own)
    n = len(lines)
    if not n:
        return Lines(np.zeros((0, N_FEATURES)), np.zeros(0), per_text)

    lengths = np.array([len(x) for x in lines], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    kinds = _classes("".join(lines))
    share = np.empty((n, _CLASSES))
    for k in range(_CLASSES):
        share[:, k] = np.add.reduceat(kinds == k, starts, dtype=np.int64) / lengths

    f = np.zeros((n, _OWN))
    words = [x.split() or [x] for x in lines]
    n_words = np.array([len(w) for w in words], float)
    letters = share[:, _LETTER] + share[:, _UPPER]
    f[:, 0] = 1
    f[:, 1] = np.log1p(lengths) / 5
    f[:, 2] = letters
    f[:, 3] = share[:, _UPPER] / np.maximum(letters, 1e-9)
    f[:, 4] = share[:, _DIGIT]
    f[:, 5] = share[:, _BLANK]
    f[:, 6] = share[:, _SYMBOL]
    f[:, 7] = share[:, _SHOUT]
    f[:, 8] = share[:, _STOP]
    f[:, 9] = share[:, _OTHER]
    f[:, 10] = [len(set(w)) / len(w) for w in words]
    f[:, 11] = np.minimum(lengths / n_words, 40) / 10
    f[:, 12] = np.log1p(n_words) / 5
    f[:, 13] = [x.rstrip()[-1:] in ".!?" for x in lines]
    f[:, 14] = [x.lstrip()[:1].isupper() for x in lines]
    f[:, 15] = [sum(map(str.__eq__, w, w[1:])) / len(w) for w in words]
    f[:, 16] = repeated
    f[:, 17] = f[:, 6] > 0.03
    f[:, 18] = f[:, 3] > 0.5
    f[:, 19] = f[:, 7] > 0.03

    # A line sees its neighbours; at an edge of the text an indicator is set instead.
    text_of = np.repeat(np.arange(len(texts)), per_text)
    parts = [f]
    for step in (1, -1):
        near = np.roll(f[:, _SEEN], step, axis=0)
        same = np.roll(text_of, step) == text_of
        same[0 if step == 1 else -1] = False
        parts += [near * same[:, None], (~same)[:, None].astype(float)]
    return Lines(np.hstack(parts), lengths.astype(float), per_text)


class Model(NamedTuple):
    """Weights of the state good against bad, transitions, and the calibration."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    transitions: np.ndarray
    slope: float
    offset: float

    def emissions(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean) / self.scale, -6, 6)
        z[:, 0] = 1
        return np.clip(z @ self.weights, -30, 30)


def marginals(
    emit: np.ndarray, per_text: np.ndarray, transitions: np.ndarray
) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over many chains at once.

    Returns the marginal of "good" for every line, the expected number of each
    transition over all chains, and the sum of the log partition functions.
    """
    n = len(emit)
    good = np.zeros(n)
    expected = np.zeros((2, 2))
    order = np.argsort(-per_text, kind="stable")
    order = order[per_text[order] > 0]
    if not len(order):
        return good, expected, 0.0
    first = (np.cumsum(per_text) - per_text)[order]
    size = per_text[order]
    longest = int(size[0])
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]
    top = np.maximum(emit, 0)
    local = np.stack([np.exp(-top), np.exp(emit - top)], axis=1)
    pair = np.exp(transitions)
    ahead = np.empty((n, 2))
    scale = np.empty(n)
    for t in range(longest):
        at = first[: active[t]] + t
        a = local[at] if t == 0 else (ahead[at - 1] @ pair) * local[at]
        total = a.sum(1)
        ahead[at] = a / total[:, None]
        scale[at] = total
    behind = np.ones((len(order), 2))
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        good[at] = ahead[at, 1] * behind[:k, 1]
        if t:
            into = local[at] * behind[:k] / scale[at][:, None]
            expected += pair * (ahead[at - 1].T @ into)
            behind[:k] = into @ pair.T
    return good, expected, float(np.log(scale).sum() + top.sum())


def document_means(good: np.ndarray, lines: Lines) -> np.ndarray:
    """The length-weighted mean of the line marginals; 0 for a text without lines."""
    text_of = np.repeat(np.arange(len(lines.per_text)), lines.per_text)
    size = len(lines.per_text)
    weight = np.bincount(text_of, lines.lengths, size)
    total = np.bincount(text_of, lines.lengths * good, size)
    return total / np.maximum(weight, 1e-9)


def fit(lines: Lines, labels: np.ndarray, steps: int = FIT_STEPS) -> Model:
    """Maximise the conditional likelihood of line states taken from document labels.

    Every line has the state of its document. Training is full-batch gradient ascent
    with per-weight steps (Adam), so it is the same for the same sample.
    """
    x = lines.features
    width = N_FEATURES
    if len(x) == 0 or len(set(labels.tolist())) < 2:
        prior = float(labels.mean()) if len(labels) else 0.5
        even = np.log((prior + 0.01) / (1.01 - prior))
        return Model(np.zeros(width), np.zeros(width), np.ones(width), np.zeros((2, 2)), 0.0, even)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    model = Model(np.zeros(width), mean, scale, np.zeros((2, 2)), 1.0, 0.0)
    z = np.clip((x - mean) / scale, -6, 6)
    z[:, 0] = 1
    state = np.repeat(labels, lines.per_text)
    pieces = np.concatenate(
        [[FIT_LINES] * (k // FIT_LINES) + [k % FIT_LINES] * bool(k % FIT_LINES) for k in lines.per_text]
    ).astype(np.int64)
    inner = np.ones(len(x), bool)
    inner[np.cumsum(pieces) - pieces] = False
    seen = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(seen, (state[at - 1].astype(int), state[at].astype(int)), 1)

    theta = np.zeros(width + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        emit = np.clip(z @ theta[:width], -30, 30)
        good, expected, _ = marginals(emit, pieces, theta[width:].reshape(2, 2))
        grad = np.concatenate([z.T @ (state - good), (seen - expected).ravel()]) / len(x)
        grad -= 1e-4 * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = model._replace(weights=theta[:width], transitions=theta[width:].reshape(2, 2))

    good, _, _ = marginals(model.emissions(x), lines.per_text, model.transitions)
    slope, offset = _calibrate(document_means(good, lines), labels)
    return model._replace(slope=slope, offset=offset)


def _calibrate(means: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Newton steps of a ridge logistic fit from the mean marginal to the label."""
    x = np.stack([means - 0.5, np.ones_like(means)], axis=1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.05, 0.05])
        w += np.linalg.solve(h, x.T @ (labels - p) - 0.05 * w)
    return float(w[0]), float(w[1])


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    """A score between 0 and 1 for each text."""
    lines = line_features(texts)
    good, _, _ = marginals(model.emissions(lines.features), lines.per_text, model.transitions)
    means = document_means(good, lines)
    out = 1 / (1 + np.exp(-np.clip(model.slope * (means - 0.5) + model.offset, -30, 30)))
    out[lines.per_text == 0] = 0.0
    return out


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on a bounded sample of labelled documents that are not held out.

    The sample has the ``fit_rows`` ids of lowest hash, at most, of those with a label and a
    text with a word, and one text of each, that of the lowest hash. The first
    ``FIT_OWN_LINES`` lines of a text count, and ids in order of hash up to
    ``FIT_ALL_LINES`` lines. Workers make the line features; only those of the sample reach
    the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = (
        labels.where(F.col("quality").isin(0, 1) & may_learn(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("quality"))
    )
    own = docs.select("doc_id", "text").where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    # An id that many rows share is one row before it meets the labels.
    known = known.join(own.select("doc_id").distinct(), "doc_id", "left_semi")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # Broadcast is bounded by fit_rows.
    sample = own.join(F.broadcast(known), "doc_id").groupBy("doc_id")
    sample = sample.agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("quality").alias("quality"))

    @tidy
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = line_features(batch["text"].tolist())
            starts = np.cumsum(lines.per_text) - lines.per_text
            kept = np.minimum(lines.per_text, FIT_OWN_LINES)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "quality": batch["quality"],
                    "lines": kept,
                    "f": [
                        lines.features[a : a + k].astype(np.float32).tobytes()
                        for a, k in zip(starts, kept)
                    ],
                    "n": [
                        lines.lengths[a : a + k].astype(np.float32).tobytes()
                        for a, k in zip(starts, kept)
                    ],
                }
            )

    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, quality double, lines long, f binary, n binary"
    made = written(sample.mapInPandas(features, schema), "features")
    order = made.select("doc_id", "lines", F.xxhash64("doc_id").alias("hash")).collect()
    order.sort(key=lambda r: (r.hash, r.doc_id))
    fits = np.cumsum([r.lines for r in order]) <= FIT_ALL_LINES
    # A table of ids, not a list in the plan.
    chosen = spark.createDataFrame([(r.doc_id,) for r, fit_in in zip(order, fits) if fit_in], f"doc_id {kind}")
    rows = made.join(F.broadcast(chosen), "doc_id", "left_semi").collect()
    rows.sort(key=lambda r: (r.doc_id, r.n, r.f))
    if not rows:
        return fit(line_features([]), np.zeros(0))
    lengths = [np.frombuffer(r.n, np.float32).astype(float) for r in rows]
    lines = Lines(
        np.concatenate([np.frombuffer(r.f, np.float32).reshape(-1, N_FEATURES) for r in rows]).astype(float),
        np.concatenate(lengths),
        np.array([len(x) for x in lengths], np.int64),
    )
    return fit(lines, np.array([r.quality for r in rows]).round())


def score_quality(
    docs: DataFrame, model: Model, output: str = "score", text: str = "text"
) -> DataFrame:
    """All columns of the documents and a score in ``output``, which it replaces if there."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    @tidy
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(scores(model, batch.tolist()))

    return docs.withColumn(output, score(F.col(text)))


def filter_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with all their columns.

    A model that no label could teach anything rejects none.
    """
    if not model.slope:
        return docs
    # The columns travel in a struct, so that no name can clash.
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))
    return score_quality(rows, model).where(F.col("score") >= threshold).select("row.*")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score_quality(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
