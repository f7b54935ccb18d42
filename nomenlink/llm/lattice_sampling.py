"""Sampled segmentation into pieces by forward filtering and backward sampling.

The lattice of a text has a node between all characters and an edge for every piece of
the public piece vocabulary; a character that is no piece has one edge of byte pieces.
The weight of a piece is ``(rank + 1) ** -alpha`` with its rank in the vocabulary. Forward
filtering sums the weights of all paths to each node; backward sampling walks from the
end, drawing an edge in proportion to the weight of the paths through it. So a path is
drawn with its share of the weight of all paths.

A blank begins a piece or stands among blanks, and no piece holds a blank after another
character. So the lattice falls apart before each run of blanks, exactly, and equal parts
of a batch share one forward pass. Draws come from a hash of the row key, the seed, the
part and the step: the same for a row on any cluster, in any partition.

A blank goes before the text and is dropped in decoding, as the vocabulary expects.
Decoding gives back every text, the blank sign ``▁`` included, which is spelt in bytes.

Defined results: a null text has null pieces; an empty text none, which decode to the
empty text. Rows of equal key and text have equal samples; a null key is a key too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, small_batches, tidy
from .vocabularies import pieces

ALPHA = 1.0
SEED = 0

_BLANK = "▁"
_PART = re.compile(" +[^ ]*")
# The first byte piece stands after the three control pieces.
_BYTES = 3
_BUCKET_BITS = 20
_SHIFT = np.uint64(64 - _BUCKET_BITS)
# Characters of different parts whose lattices are held at once.
HELD = 400_000
# Texts of a batch; equal parts of a batch share a lattice.
TEXTS = 1024


class Vocabulary:
    """Pieces with blanks as spaces, their weights, and a table of all their prefixes."""

    def __init__(self, folder: str | None, alpha: float):
        model = pieces(folder)
        n = model.get_piece_size()
        self.strings = [model.id_to_piece(i).replace(_BLANK, " ") for i in range(n)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) for i in range(n)]
        rank = np.maximum(-np.array([model.get_score(i) for i in range(n)]), 0)
        self.log_weight = -alpha * np.log1p(rank)
        self.log_byte = -alpha * np.log1p(n)
        self.longest = max(len(s) for s, p in zip(self.strings, plain) if p)
        known = {s: i for i, (s, p) in enumerate(zip(self.strings, plain)) if p}
        prefixes = sorted({s[:k] for s in known for k in range(1, len(s) + 1)})
        hashes = np.array([self._hash(p) for p in prefixes], np.uint64)
        if len(set(hashes.tolist())) != len(hashes):
            raise ValueError("two prefixes of the vocabulary have one hash")
        order = np.argsort(hashes)
        # Sorted hashes fall into buckets by their highest bits.
        self.hashes = np.append(hashes[order], np.zeros(1, np.uint64))
        bucket = (hashes[order] >> _SHIFT).astype(np.int64)
        self.bucket = np.searchsorted(bucket, np.arange((1 << _BUCKET_BITS) + 1)).astype(np.int32)
        self.widest = int(np.diff(self.bucket).max())
        self.piece = np.array([known.get(p, -1) for p in prefixes], np.int64)[order]
        self.single = {s for s in known if len(s) == 1}

    @staticmethod
    def _hash(text: str) -> int:
        value = np.zeros(1, np.uint64)
        for c in text:
            value = extend(value, np.array([ord(c)], np.uint64))
        return int(value[0])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether hashes are of prefixes, and the pieces that they are (or -1)."""
        at = self.bucket[(hashes >> _SHIFT).astype(np.intp)]
        piece = np.full(len(hashes), -1, np.int64)
        found = np.zeros(len(hashes), bool)
        for _ in range(self.widest):
            same = self.hashes[at] == hashes
            piece[same] = self.piece[at[same]]
            found |= same
            at = np.minimum(at + 1, len(self.hashes) - 1)
        return found, piece


@cache
def vocabulary(folder: str | None, alpha: float) -> Vocabulary:
    return Vocabulary(folder, alpha)


def extend(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings with one more character."""
    with np.errstate(over="ignore"):
        return mix64((hashes ^ codes) + np.uint64(0x9E3779B97F4A7C15))


class Lattices:
    """The lattices of different parts, with edges in order of the node that they end in.

    Nodes of part p are ``base[p]`` to ``base[p] + length``. Edges of a node carry its
    number plus the share of the weight of all paths that end there, summed up, so that
    one search finds the edge for a draw.
    """

    def __init__(self, parts: list[str], vocab: Vocabulary):
        text = "".join(parts)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.array([len(p) for p in parts], np.int64)
        self.lengths = lengths
        self.base = np.cumsum(lengths + 1) - lengths - 1
        part = np.repeat(np.arange(len(parts)), lengths)
        begin = np.cumsum(lengths) - lengths
        within = np.arange(len(codes)) - begin[part]
        left = lengths[part] - within
        node = self.base[part] + within

        starts, ends, pieces_ = [], [], []
        at = np.arange(len(codes))
        hashes = np.zeros(len(codes), np.uint64)
        for size in range(1, vocab.longest + 1):
            inside = left[at] >= size
            at, hashes = at[inside], hashes[inside]
            hashes = extend(hashes, codes[at + size - 1])
            found, piece = vocab.find(hashes)
            if size == 1:
                # Characters that are no piece go by bytes; their code stands for them.
                piece_of = np.where(piece >= 0, piece, -1 - codes[at].astype(np.int64))
                known = np.ones(len(at), bool)
            else:
                piece_of, known = piece, piece >= 0
            starts.append(node[at[known]])
            ends.append(node[at[known]] + size)
            pieces_.append(piece_of[known])
            at, hashes = at[found], hashes[found]
        start, end, piece = (np.concatenate(x) for x in (starts, ends, pieces_))
        order = np.argsort(end, kind="stable")
        self.start, self.end, self.piece = start[order], end[order], piece[order]
        self._filter(vocab)

    def _filter(self, vocab: Vocabulary) -> None:
        weight = np.where(
            self.piece >= 0,
            vocab.log_weight[np.maximum(self.piece, 0)],
            vocab.log_byte * _utf8_size(-1 - self.piece),
        )
        n_nodes = int((self.lengths + 1).sum())
        # Edges of a node are the run from first to last; each node but a base has some.
        last = np.cumsum(np.bincount(self.end, minlength=n_nodes))
        first = np.append(0, last[:-1])
        total = np.zeros(n_nodes)
        share = np.empty(len(self.end))
        longest = int(self.lengths.max(initial=0))
        by_length = np.argsort(-self.lengths, kind="stable")
        base, sizes = self.base[by_length], self.lengths[by_length]
        for depth in range(1, longest + 1):
            nodes = base[: np.searchsorted(-sizes, -depth, side="right")] + depth
            k = last[nodes] - first[nodes]
            heads = np.cumsum(k) - k
            edges = np.repeat(first[nodes] - heads, k) + np.arange(k.sum())
            value = total[self.start[edges]] + weight[edges]
            top = np.maximum.reduceat(value, heads)
            value = np.exp(value - np.repeat(top, k))
            sums = np.add.reduceat(value, heads)
            total[nodes] = top + np.log(sums)
            share[edges] = value / np.repeat(sums, k)
        self.total = total
        summed = np.cumsum(share)
        before = np.where(first > 0, summed[np.maximum(first - 1, 0)], 0.0)
        within = np.minimum(summed - before[self.end], 1.0)
        within[last[last > first] - 1] = 1.0
        self.draws = self.end + within
        self.last_edge = last - 1

    def sample(self, part: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each occurrence of a part its pieces in order: pieces, and how many."""
        node = self.base[part] + self.lengths[part]
        base = self.base[part]
        # Equal parts side by side read the same edges.
        at = np.argsort(part, kind="stable")
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        counts = np.zeros(len(part), np.int64)
        step = 0
        while len(at):
            draw = mix64(seeds[at] ^ mix64(np.array([step + 1])))
            unit = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = np.searchsorted(self.draws, node[at] + unit, side="right")
            # A draw of nearly one may be rounded up to the next node.
            edge = np.minimum(edge, self.last_edge[node[at]])
            drawn.append((at, self.piece[edge]))
            counts[at] += 1
            node[at] = self.start[edge]
            at = at[node[at] > base[at]]
            step += 1
        begin = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for k, (rows, piece) in enumerate(drawn):
            out[begin[rows] + counts[rows] - 1 - k] = piece
        return out, counts


def _utf8_size(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)


def _spell(out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with characters spelt in byte pieces, and how many ids each entry gives."""
    other = np.flatnonzero(out < 0)
    counts = np.ones(len(out), np.int64)
    if not len(other):
        return out, counts
    codes, at = np.unique(-1 - out[other], return_inverse=True)
    spelt = [[b + _BYTES for b in chr(c).encode("utf-8", "surrogatepass")] for c in codes.tolist()]
    sizes = np.array([len(s) for s in spelt])
    counts[other] = sizes[at]
    ids = np.repeat(out, counts)
    begin = np.cumsum(counts) - counts
    flat, heads = np.concatenate(spelt), np.cumsum(sizes) - sizes
    for k in range(4):
        rows = other[counts[other] > k]
        ids[begin[rows] + k] = flat[heads[at[counts[other] > k]] + k]
    return ids, counts


def sample_batch(texts: list[str], seeds: np.ndarray, vocab: Vocabulary) -> list[np.ndarray]:
    """The sampled ids of each text."""
    index: dict[str, int] = {}
    occurrences = [
        np.array([index.setdefault(p, len(index)) for p in _PART.findall(" " + t)] if t else [], np.int64)
        for t in texts
    ]
    if not index:
        return [np.zeros(0, np.uint32) for _ in texts]
    sizes = np.array([len(o) for o in occurrences])
    row = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = mix64(seeds[row] ^ mix64(place + 1))
    part = np.concatenate(occurrences)

    # Lattices of some parts at a time, so that memory follows the longest part only.
    parts = list(index)
    group = np.cumsum([len(p) for p in parts]) // HELD
    counts = np.zeros(len(part), np.int64)
    found = []
    for g in np.unique(group).tolist():
        low, high = np.searchsorted(group, [g, g + 1])
        here = np.flatnonzero((part >= low) & (part < high))
        out, k = Lattices(parts[low:high], vocab).sample(part[here] - low, own[here])
        counts[here] = k
        found.append((here, out))
    begin = np.cumsum(counts) - counts
    joined = np.empty(int(counts.sum()), np.int64)
    for here, out in found:
        k = counts[here]
        joined[np.repeat(begin[here] - np.cumsum(k) + k, k) + np.arange(len(out))] = out
    ids, spelt = _spell(joined)
    per_text = np.bincount(np.repeat(row, counts), spelt, len(texts)).astype(np.int64)
    return np.split(ids.astype(np.uint32), np.cumsum(per_text)[:-1])


def decode_ids(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text of ids; runs of byte pieces are read together."""
    out: list[bytes] = []
    strings = vocab.strings
    for i in ids.tolist():
        out.append(bytes((i - _BYTES,)) if _BYTES <= i < _BYTES + 256 else strings[i].encode("utf-8", "surrogatepass"))
    return b"".join(out).decode("utf-8", "surrogatepass")[1:]


def encode(
    text: Column, key: Column, alpha: float = ALPHA, seed: int = SEED, folder: str | None = None
) -> Column:
    """Sampled piece ids as little-endian unsigned 32-bit numbers in a binary value."""

    @F.pandas_udf("binary")
    @tidy
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        vocab = vocabulary(folder, alpha)
        for texts, keys in batches:
            seeds = mix64(keys.to_numpy(np.int64).view(np.uint64))
            found = sample_batch([t or "" for t in texts], seeds, vocab)
            yield pd.Series(
                [None if t is None else ids.astype("<u4").tobytes() for t, ids in zip(texts, found)]
            )

    return run(text, F.xxhash64(F.lit(seed), key))


def decode(ids: Column, folder: str | None = None) -> Column:
    """The texts of values that ``encode`` gives."""

    @F.pandas_udf("string")
    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(folder, ALPHA)
        for batch in batches:
            yield pd.Series(
                [None if b is None else decode_ids(np.frombuffer(b, "<u4"), vocab) for b in batch]
            )

    return run(ids)


def digest(docs: DataFrame, alpha: float = ALPHA, seed: int = SEED, folder: str | None = None) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, lossless`` of every document, keyed by its doc_id."""
    small_batches(docs.sparkSession, TEXTS)
    sampled = docs.select(
        "doc_id", "text", encode(F.col("text"), F.col("doc_id"), alpha, seed, folder).alias("ids")
    )
    return sampled.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        (decode(F.col("ids"), folder) == F.col("text")).alias("lossless"),
    )
