"""Vectors as short codes: Lloyd rounds over cover trees, with integer arithmetic.

A vector is cut into equal parts, and each part position has a codebook of its own. A code
is the number of the nearest entry (squared Euclidean distance, ties to the lower number)
for every part. Components are scaled to integers first, so that distances, sums and means
are exact and no result depends on how rows are dealt out.

* Workers take the rows of a partition in chunks of bounded size and build one cover tree
  per part position over each: levels of halving radii, every node with a centre that is a
  point of it and the true covering radius. Points stand in tree order, so the points of a
  subtree are a range and cumulative sums give its count and sum. The trees are written
  once and serve all rounds.
* An assignment goes down the trees. The entries that may be nearest to some point of a
  subtree are those within two covering radii of the nearest one to its centre. Where
  a single entry is left, the whole subtree goes to it by its cumulative sums; only
  ambiguous nodes descend, and points below the last nodes are compared exactly.
* A round sends one row per entry and part from each task; codebooks are as large as their
  parameters say, whatever the number of vectors.

Defined results: vectors that are null, empty, hold null or non-finite components, or have
another dimension than most (the smaller one if two are as common) are dropped. Where the
number of parts does not divide the dimension, vectors are filled up with zeros. Scaled
components beyond 2**27 either way count as 2**27, so that all sums fit 64 bits. The first
entries come from the smallest ids that are not null; of rows that repeat an id the least
vector counts there. Rows that repeat an id, and rows without one, have codes of their
own. With fewer ids than entries the codebooks are shorter; with none, entries come from
no row and there are no codes. An empty table gives no rows. Without a column ``label``
all rows have the same. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import attach
from ..sources.staging import stage
from .common import tidy, written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LIMIT = 1 << 27
# Vectors of one chunk, and so of one set of trees.
CHUNK = 2048
# Nodes of no more points have no children.
LEAF = 8
# Relative slack of the bounds for rounding; exact comparisons have none.
SLACK = 1e-9
# Nodes or points compared with all entries at once.
_SLICE = 4096


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Components as integers, rounded down."""
    return np.clip(np.floor(np.asarray(vectors, np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64)


class Trees(NamedTuple):
    """Cover trees over the parts of a chunk, one per part position.

    Point ``p * n + i`` is part ``p`` of row ``i``. ``order`` lists the points so that each
    node has those from ``start`` to ``end``. Children of a node are neighbours, from
    ``child`` on; the roots are the first nodes, one per part position.
    """

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(1))


def plant(points: np.ndarray, roots: int, leaf: int = LEAF) -> Trees:
    """Build the trees over ``points``, which hold equally many for each root in turn.

    All nodes of a level are split at once. A node's first child keeps its centre; then
    the first point of it that no child covers becomes the next centre, until all its
    points are covered. So children of a node are further apart than their radius.
    """
    n = len(points) // roots
    order = np.arange(len(points))
    starts = [np.arange(roots) * n]
    ends = [np.arange(1, roots + 1) * n]
    centres = [starts[0].copy()]
    radii = [np.maximum.reduceat(_lengths(points - np.repeat(points[centres[0]], n, 0)), starts[0])]
    child, children = [np.full(roots, -1)], [np.zeros(roots, np.int64)]
    # What may still be split, as numbers of nodes.
    open_nodes = np.arange(roots)
    made = roots
    reach = float(2.0 ** np.ceil(np.log2(max(radii[0].max(), 1))))
    start, end, centre, radius = starts[0], ends[0], centres[0], radii[0]
    while True:
        keep = (end - start > leaf) & (radius > 0)
        open_nodes, start, end, centre, radius = (
            v[keep] for v in (open_nodes, start, end, centre, radius)
        )
        if not len(open_nodes):
            break
        reach /= 2
        split = np.flatnonzero(radius > reach)
        if not len(split):
            continue
        # The places of the points of all nodes to split, node after node.
        sizes = end[split] - start[split]
        first = np.cumsum(sizes) - sizes
        places = np.arange(sizes.sum()) - np.repeat(first - start[split], sizes)
        owner = np.repeat(np.arange(len(split)), sizes)
        who = order[places]
        number = np.full(len(who), -1)
        far = np.zeros(len(who))
        left = np.arange(len(who))
        picks = centre[split]
        turn_centres = []
        turn = 0
        while len(left):
            mine = owner[left]
            distance = _lengths(points[who[left]] - points[picks[mine]])
            near = distance <= reach
            number[left[near]] = turn
            far[left[near]] = distance[near]
            turn_centres.append(picks)
            left = left[~near]
            picks = np.full(len(split), -1)
            heads = np.flatnonzero(np.diff(owner[left], prepend=-1))
            picks[owner[left[heads]]] = who[left[heads]]
            turn += 1
        again = np.lexsort((number, owner))
        order[places] = who[again]
        owner, number, far = owner[again], number[again], far[again]
        heads = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(number, prepend=-1) != 0))
        new_start = places[heads]
        new_end = new_start + np.diff(heads, append=len(owner))
        new_centre = np.stack(turn_centres)[number[heads], owner[heads]]
        new_radius = np.maximum.reduceat(far, heads)
        per_node = np.bincount(owner[heads], minlength=len(split))
        all_child, all_children = np.concatenate(child), np.concatenate(children)
        all_child[open_nodes[split]] = made + np.cumsum(per_node) - per_node
        all_children[open_nodes[split]] = per_node
        new = np.arange(made, made + len(heads))
        made += len(heads)
        child = [all_child, np.full(len(new), -1)]
        children = [all_children, np.zeros(len(new), np.int64)]
        for held, more in ((starts, new_start), (ends, new_end), (centres, new_centre), (radii, new_radius)):
            held.append(more)
        rest = np.setdiff1d(np.arange(len(open_nodes)), split)
        open_nodes = np.concatenate([open_nodes[rest], new])
        start, end, centre, radius = (
            np.concatenate([old[rest], more])
            for old, more in ((start, new_start), (end, new_end), (centre, new_centre), (radius, new_radius))
        )
    return Trees(
        order, *(np.concatenate(v) for v in (starts, ends, centres, radii, child, children))
    )


def _squares(points: np.ndarray, books: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Exact squared distances of each point to all entries of its part's codebook."""
    out = np.empty((len(points), books.shape[1]), np.int64)
    for low in range(0, len(points), _SLICE):
        some = slice(low, low + _SLICE)
        apart = points[some, None, :] - books[part[some]]
        out[some] = np.einsum("nkd,nkd->nk", apart, apart)
    return out


_FAR = np.iinfo(np.int64).max


def assign(trees: Trees, points: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ranges of points in tree order, and the entry that each goes to.

    Gives ``start, end, entry, alone``: with ``alone``, the range is a single point that
    was compared by itself.
    """
    n = len(points) // len(books)
    nodes = np.arange(len(books))
    may = np.ones((len(nodes), books.shape[1]), bool)
    found = []
    while len(nodes):
        centre = trees.centre[nodes]
        squares = np.where(may, _squares(points[centre], books, centre // n), _FAR)
        best = squares.argmin(1)
        apart = np.sqrt(squares.astype(np.float64))
        limit = apart[np.arange(len(nodes)), best] + 2 * trees.radius[nodes]
        may &= apart <= (limit * (1 + SLACK) + SLACK)[:, None]
        # Equal points go to the same entry; other subtrees only where one entry is left.
        settled = (trees.radius[nodes] == 0) | (may.sum(1) == 1)
        whole = nodes[settled]
        found.append((trees.start[whole], trees.end[whole], best[settled], np.zeros(len(whole), bool)))
        nodes, may = nodes[~settled], may[~settled]
        last = trees.children[nodes] == 0
        at, mask = nodes[last], may[last]
        if len(at):
            sizes = trees.end[at] - trees.start[at]
            places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - trees.start[at], sizes)
            who = trees.order[places]
            squares = np.where(np.repeat(mask, sizes, 0), _squares(points[who], books, who // n), _FAR)
            found.append((places, places + 1, squares.argmin(1), np.ones(len(places), bool)))
        inner, may = nodes[~last], may[~last]
        many = trees.children[inner]
        nodes = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - trees.child[inner], many)
        may = np.repeat(may, many, 0)
    return tuple(np.concatenate(v) for v in zip(*found))


def totals(trees: Trees, points: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many parts go to each entry of each codebook, and their componentwise sums."""
    start, end, entry, _ = assign(trees, points, books)
    before = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[trees.order], 0)])
    place = trees.order[start] // (len(points) // len(books)) * books.shape[1] + entry
    counts = np.zeros(books.shape[0] * books.shape[1], np.int64)
    sums = np.zeros((len(counts), points.shape[1]), np.int64)
    np.add.at(counts, place, end - start)
    np.add.at(sums, place, before[end] - before[start])
    return counts.reshape(books.shape[:2]), sums.reshape(books.shape)


def codes(trees: Trees, points: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of every part, as rows by parts, and the summed squared distances by row."""
    start, end, entry, _ = assign(trees, points, books)
    in_order = np.argsort(start)
    by_point = np.empty(len(points), np.int64)
    by_point[trees.order] = np.repeat(entry[in_order], (end - start)[in_order])
    n = len(points) // len(books)
    apart = points - books[np.repeat(np.arange(len(books)), n), by_point]
    errors = (apart**2).sum(1).reshape(len(books), n).sum(0)
    return by_point.reshape(len(books), n).T, errors


def moved(books: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Every used entry becomes the mean of its parts, rounded down."""
    used = counts > 0
    return np.where(used[..., None], sums // np.maximum(counts, 1)[..., None], books)


def books_sha256(books: np.ndarray) -> str:
    """A digest of all components in order."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _usable(vectors: DataFrame) -> DataFrame:
    """The rows with a finite vector of the commonest length, as ``vec_id, label, x``."""
    # Widened before the test, and one expression for it.
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    rows = vectors.select("vec_id", label, x.alias("x")).where((F.size("x") > 0) & finite)
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.agg(F.min_by("size", F.struct(-F.col("n"), F.col("size")))).first()[0]
    return rows.where(F.size("x") == F.lit(common if common is not None else 0))


def _points(x: np.ndarray, parts: int) -> np.ndarray:
    """The parts of scaled vectors, position after position."""
    fill = -x.shape[1] % parts
    x = np.pad(x, ((0, 0), (0, fill)))
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2)).reshape(
        len(x) * parts, -1
    )


def first_books(usable: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The parts of the vectors with the smallest ids; null if there is none."""
    known = usable.where(F.col("vec_id").isNotNull())
    # No more rows than a codebook has entries.
    ids = known.select("vec_id").distinct().orderBy("vec_id").limit(entries)
    whole = F.transform("x", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))))
    least = known.join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min(whole).alias("x"))
    rows = least.orderBy("vec_id").collect()
    if not rows:
        return None
    x = np.array([r.x for r in rows], np.int64)
    return _points(x, parts).reshape(parts, len(x), -1)


_LONGS, _FIELDS = pa.list_(pa.int32()), Trees._fields


def _flat(array: pa.Array, kind: type) -> np.ndarray:
    return array.flatten().to_numpy(zero_copy_only=False).astype(kind)


def plant_all(usable: DataFrame, parts: int) -> DataFrame:
    """The rows in chunks, one row each, with the trees over their parts; written once.

    A chunk holds ``vec_id`` and ``label`` as lists, and ``x``, the scaled components.
    """
    fields = {f.name: f.dataType for f in usable.schema.fields}
    schema = T.StructType(
        [T.StructField(c, T.ArrayType(fields[c])) for c in ("vec_id", "label")]
        + [T.StructField("x", T.ArrayType(T.IntegerType()))]
        + [
            T.StructField(f, T.ArrayType(T.DoubleType() if f == "radius" else T.IntegerType()))
            for f in _FIELDS
        ]
    )

    def chunk(part: pa.Table) -> pa.RecordBatch:
        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        x = part["x"].combine_chunks()
        x = scaled(_flat(x, np.float64).reshape(len(part), -1))
        trees = plant(_points(x, parts), parts)
        arrays = [one(part[c].combine_chunks()) for c in ("vec_id", "label")]
        arrays.append(one(pa.array(x.ravel().astype(np.int32))))
        for field, values in zip(_FIELDS, trees):
            arrays.append(one(pa.array(values if field == "radius" else values.astype(np.int32))))
        return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    @tidy
    def plant_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, CHUNK - size)
                batch = batch.slice(take.num_rows)
                held.append(take)
                size += take.num_rows
                if size == CHUNK:
                    yield chunk(pa.Table.from_batches(held))
                    held, size = [], 0
        if size:
            yield chunk(pa.Table.from_batches(held))

    # Small row groups, so that a reader holds a few chunks at once.
    made = usable.select("vec_id", "label", "x").mapInArrow(plant_chunks, schema)
    return written(made, "trees", **{"parquet.block.size": 16 << 20})


def _chunks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, Trees, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            trees = Trees(
                *(_flat(row.column(f), np.float64 if f == "radius" else np.int64) for f in _FIELDS)
            )
            x = _flat(row.column("x"), np.int64)
            yield row, trees, _points(x.reshape(len(trees.order) // parts, -1), parts)


def lloyd(trees: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after some rounds over all chunks."""
    parts, entries, width = books.shape
    sums = [f"s{i}" for i in range(width)]
    schema = "part int, entry int, n long, " + ", ".join(f"{s} long" for s in sums)
    for _ in range(rounds):
        now = books

        @tidy
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(now.shape[:2], np.int64), np.zeros(now.shape, np.int64)
            for _, own, points in _chunks(batches, parts):
                more, sums_of = totals(own, points, now)
                n += more
                total += sums_of
            at = np.argwhere(n > 0)
            columns = [at[:, 0].astype(np.int32), at[:, 1].astype(np.int32), n[n > 0]]
            columns += list(total[n > 0].T)
            names = ["part", "entry", "n", *sums]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        rows = trees.select("x", *_FIELDS).mapInArrow(count, schema).groupBy("part", "entry")
        n, total = np.zeros(now.shape[:2], np.int64), np.zeros(now.shape, np.int64)
        # One row per entry and part.
        for r in rows.agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in sums)).collect():
            n[r.part, r.entry] = r.n
            total[r.part, r.entry] = [r[s] for s in sums]
        books = moved(now, n, total)
    return books


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of every usable vector, and the codebooks.

    A code has the entries of all parts in order, as two hex digits each (so ``entries``
    is 256 at most). The codebooks have one row per part position and entry.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for an entry, so 1 to 256 of them")
    usable = _usable(vectors)
    books = first_books(usable, parts, entries)
    kinds = {f.name: f.dataType for f in usable.schema.fields}
    schema = T.StructType(
        [T.StructField(c, kinds[c]) for c in ("vec_id", "label")]
        + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    )
    if books is None:
        none = np.zeros((parts, 0, 0), np.int64)
        return usable.sparkSession.createDataFrame([], schema), none
    trees = plant_all(usable, parts)
    books = lloyd(trees, books, rounds)

    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, own, points in _chunks(batches, parts):
            entry, errors = codes(own, points, books)
            text = entry.astype(np.uint8).tobytes().hex()
            step = 2 * parts
            columns = [row.column("vec_id").flatten(), row.column("label").flatten()]
            columns.append(pa.array([text[i : i + step] for i in range(0, len(text), step)]))
            columns.append(pa.array(errors))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return trees.mapInArrow(encode, schema), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add ``label_error``: the error summed over all rows with an equal label."""
    coded = written(coded, "codes")

    def per_label() -> DataFrame:
        return coded.groupBy("label").agg(
            F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")
        )

    errors = stage(per_label().drop("n"), "label_errors")
    return attach(coded, errors, [("label", "label")], "left", lambda: per_label().drop("label_error"))


def digest(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable vector."""
    coded, books = compress(vectors)
    return with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256")
    )
