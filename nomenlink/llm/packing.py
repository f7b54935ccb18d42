"""Best-fit packing: bin completion branch-and-bound over piece lengths.

Documents become token ids and a separator; only documents longer than a sequence are
cut, into whole sequences and one shorter first piece. Sequences differ only by the
lengths that they hold, so the search works on the number of pieces of each length: a
table with one row per possible length, whatever the number of documents. It yields
patterns (which lengths share a sequence) and how often each is used. Spark jobs number
the pieces of each length, and a join turns a number into a sequence and a place there.

The search takes the largest length left and enumerates fillings of the rest of its
sequence, least waste first. A filling is skipped when another dominates it (a larger
piece fits in its waste, in place of one or of two of its pieces), and a branch is cut
when its waste exceeds what a better solution may waste. Best-fit decreasing gives the
first incumbent. A filling is used as often as the counts allow before smaller numbers
are tried. The search ends when the incumbent meets the lower bound or ``steps`` are
spent; the packing is whole either way.

Defined results: a null or empty text is one separator. Repeated rows and ids, and null
ids, are packed row by row. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_id, small_batches, tidy, with_key, written
from .vocabularies import encode_ids

CAPACITY = 2048
SEPARATOR = 0
# Search steps after the incumbent of best fit.
STEPS = 100_000

Filling = tuple[tuple[int, int], ...]
"""Pairs of a length and how many pieces of it, longest first."""


class Use(NamedTuple):
    """A filling and the number of sequences that have it."""

    filling: Filling
    times: int


class Packing(NamedTuple):
    uses: list[Use]
    sequences: int
    lower_bound: int


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by volume, and by pieces that cannot share."""
    best = -(-sum(n * k for n, k in counts.items()) // capacity)
    lengths = sorted(counts)
    for small in [0, *[x for x in lengths if 2 * x <= capacity]]:
        alone = sum(counts[x] for x in lengths if x > capacity - small)
        large = [x for x in lengths if 2 * x > capacity and x <= capacity - small]
        n_large = sum(counts[x] for x in large)
        room = n_large * capacity - sum(x * counts[x] for x in large)
        rest = sum(x * counts[x] for x in lengths if small <= x and 2 * x <= capacity)
        best = max(best, alone + n_large + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Use]:
    """Best-fit decreasing, all sequences of equal content at once."""
    by_room: list[dict[Filling, int]] = [{} for _ in range(capacity + 1)]

    def put(filling: Filling, room: int, times: int) -> None:
        by_room[room][filling] = by_room[room].get(filling, 0) + times

    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in range(length, capacity + 1):
            each = room // length
            for filling in list(by_room[room]):
                if not left:
                    break
                times = by_room[room].pop(filling)
                full = min(times, left // each)
                rest = left - full * each if full < times else 0
                if full:
                    put((*filling, (length, each)), room - each * length, full)
                if rest:
                    put((*filling, (length, rest)), room - rest * length, 1)
                kept = times - full - bool(rest)
                if kept:
                    put(filling, room, kept)
                left -= full * each + rest
            if not left:
                break
        each = capacity // length
        if left // each:
            put(((length, each),), capacity - each * length, left // each)
        if left % each:
            put(((length, left % each),), capacity - left % each * length, 1)
    return [Use(f, n) for fillings in by_room for f, n in fillings.items()]


class _Spent(Exception):
    """The search used up its steps."""


class _Search:
    def __init__(self, counts: dict[int, int], capacity: int, bound: int, steps: int):
        self.left = dict(counts)
        self.lengths = sorted(counts)
        self.capacity = capacity
        self.bound = bound
        self.steps = steps

    def _step(self) -> None:
        self.steps -= 1
        if self.steps < 0:
            raise _Spent

    def _largest(self, at_most: int) -> int | None:
        """The largest length left that is not above the given one."""
        i = bisect_right(self.lengths, at_most) - 1
        while i >= 0:
            if self.left[self.lengths[i]]:
                return self.lengths[i]
            i -= 1
        return None

    def _sums(self, target: int, at_most: int) -> Iterator[Filling]:
        """Fillings of exactly the target from the pieces left, long pieces first."""
        if target == 0:
            yield ()
            return
        length = self._largest(min(target, at_most))
        while length is not None:
            self._step()
            for times in range(min(self.left[length], target // length), 0, -1):
                for rest in self._sums(target - times * length, length - 1):
                    yield ((length, times), *rest)
            length = self._largest(length - 1)

    def _dominated(self, filling: Filling, waste: int) -> bool:
        """Whether a piece left would fill the waste, or replace one piece or two."""
        taken = dict(filling)

        def spare(low: int, high: int) -> bool:
            length = self._largest(high)
            while length is not None and length >= low:
                if self.left[length] > taken.get(length, 0):
                    return True
                length = self._largest(length - 1)
            return False

        if waste and spare(1, waste):
            return True
        own = [x for x, times in filling for _ in range(min(times, 2))]
        if waste and any(spare(x + 1, x + waste) for x in taken):
            return True
        pairs = {a + b for i, a in enumerate(own) for b in own[i + 1 :]}
        return any(spare(s, s + waste) for s in pairs)

    def _fillings(self, room: int, allowed: int) -> Iterator[tuple[Filling, int]]:
        for waste in range(min(allowed, room) + 1):
            self._step()
            for filling in self._sums(room - waste, room):
                if not self._dominated(filling, waste):
                    yield filling, waste

    def _branches(self, allowed: int) -> Iterator[tuple[Use, int]]:
        """Uses of a filling around the largest piece left, and their waste."""
        longest = self._largest(self.capacity)
        self.left[longest] -= 1
        options = self._fillings(self.capacity - longest, allowed)
        while True:
            # The pieces left must be as here while the next filling is looked for.
            found = next(options, None)
            if found is None:
                break
            filling, waste = found
            whole = dict(filling)
            whole[longest] = whole.get(longest, 0) + 1
            self.left[longest] += 1
            most = min(self.left[x] // k for x, k in whole.items())
            if waste:
                most = min(most, allowed // waste)
            for times in range(most, 0, -1):
                self._step()
                use = Use(tuple(sorted(whole.items(), reverse=True)), times)
                for x, k in whole.items():
                    self.left[x] -= k * times
                yield use, waste * times
                for x, k in whole.items():
                    self.left[x] += k * times
            self.left[longest] -= 1
        self.left[longest] += 1

    def improve(self, incumbent: list[Use]) -> list[Use]:
        """The best packing found by a depth-first search with an explicit stack."""
        best = incumbent
        total = sum(x * n for x, n in self.left.items())
        used = sum(u.times for u in best)
        if used <= self.bound:
            return best
        allowed = (used - 1) * self.capacity - total
        path: list[tuple[Use, int]] = []
        stack = [self._branches(allowed)]
        try:
            while stack:
                branch = next(stack[-1], None)
                if branch is None:
                    stack.pop()
                    if path:
                        path.pop()
                    continue
                path.append(branch)
                wasted = sum(w for _, w in path)
                if wasted > allowed:
                    path.pop()
                    continue
                if self._largest(self.capacity) is None:
                    best = [u for u, _ in path]
                    used = sum(u.times for u in best)
                    if used <= self.bound:
                        break
                    allowed = (used - 1) * self.capacity - total
                    path.pop()
                    continue
                stack.append(self._branches(allowed - wasted))
        except _Spent:
            pass
        return best


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Packing:
    """A packing of so many pieces of each length into few sequences."""
    counts = {x: n for x, n in counts.items() if n}
    if not counts:
        return Packing([], 0, 0)
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError(f"lengths must be between 1 and {capacity}")
    bound = lower_bound(counts, capacity)
    whole = counts.pop(capacity, 0)
    uses = best_fit(counts, capacity)
    if counts:
        uses = _Search(counts, capacity, bound - whole, steps).improve(uses)
    if whole:
        uses = [Use(((capacity, 1),), whole), *uses]
    return Packing(uses, sum(u.times for u in uses), bound)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n tokens."""
    first = n % capacity or min(n, capacity)
    ends = [0, *range(first, n + 1, capacity)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def token_pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    separator: int = SEPARATOR,
    folder: str | None = None,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``, and its
    number among the pieces of its length in its task (``task``, ``nth``)."""
    small_batches(docs.sparkSession)
    keyed = with_key(docs, "text")

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            texts = ["" if t is None else t for t in batch["text"]]
            found = zip(batch["absent"], batch["id"], encode_ids(texts, folder))
            for absent, own_id, ids in found:
                ids = np.append(ids, np.uint32(separator)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    nth = seen[length]
                    seen[length] += 1
                    crc = zlib.crc32(own.tobytes())
                    rows.append((absent, own_id, piece, start, length, crc, task, nth))
            yield pd.DataFrame(rows, columns=_PIECE)

    id_type = dict(keyed.dtypes)["id"]
    found = keyed.mapInPandas(
        run,
        f"absent boolean, id {id_type}, piece int, start long, length long, ids_crc32 long, "
        "task int, nth long",
    )
    return found.select(doc_id(), *_PIECE[2:])


_PIECE = ["absent", "id", "piece", "start", "length", "ids_crc32", "task", "nth"]


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    separator: int = SEPARATOR,
    folder: str | None = None,
    steps: int = STEPS,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    ``docs`` has doc_id and text; other columns are not read.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, capacity, separator, folder), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    # One row per length, at most as many as a sequence has tokens.
    found = per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()
    packing = pack_lengths({r.length: r.n for r in found}, capacity, steps)

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_task.select(
        "length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first")
    )
    numbered = pieces.join(firsts, ["task", "length"]).withColumn(
        "_rank", F.col("_first") + F.col("nth")
    )
    slots = spark.createDataFrame(
        _slots(packing), "_length long, _from long, _to long, _sequence long, _each long, _place long"
    )
    # A search step uses up a length or is backed out, so the number of slots is bounded
    # by the number of lengths, not by the documents.
    placed = numbered.join(
        F.broadcast(slots),
        (F.col("length") == F.col("_length"))
        & (F.col("_rank") >= F.col("_from"))
        & (F.col("_rank") < F.col("_to")),
    )
    within = F.col("_rank") - F.col("_from")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("_sequence") + F.floor(within / F.col("_each"))).alias("sequence_id"),
        (F.col("_place") + within % F.col("_each") * F.col("length")).alias("offset"),
    )


def _slots(packing: Packing) -> list[tuple[int, int, int, int, int, int]]:
    """For each use and length: the numbers that it takes, its first sequence, how many
    pieces each sequence has, and where the first of them lies."""
    out = []
    taken: dict[int, int] = {}
    sequence = 0
    for use in packing.uses:
        place = 0
        for length, each in use.filling:
            first = taken.get(length, 0)
            taken[length] = first + each * use.times
            out.append((length, first, taken[length], sequence, each, place))
            place += length * each
        sequence += use.times
    return out
