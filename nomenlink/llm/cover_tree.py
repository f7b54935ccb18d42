"""Embedding near-duplicates by a dual traversal of nested cover levels.

Unit vectors with cosine of at least ``THRESHOLD`` lie within ``sqrt(2 - 2 cosine)`` of
each other, so links are pairs within a radius, and exact threshold pairs come from a
cover tree: levels of centres whose radii halve, each level nested in the one above.

* The top level is fitted on a bounded sample of vectors: greedy centres of a radius that
  is halved until there are enough cells. Every vector belongs to its nearest centre; the
  covering radius of a cell is the true one over all its vectors.
* A cell is worked on in blocks of bounded size. A block gets the lower levels: greedy
  centres of halving radii down to a quarter of the link radius.
* Pairs of cells, vectors against cells, and then pairs of nodes level by level are
  pruned when the distance of the centres exceeds the covering radii and the link
  radius. A pair of nodes is linked as a whole, without expanding it, when the distance
  and the radii together lie within the link radius. What neither bound settles goes on
  to the children; single vectors are compared by cosine in double precision.

Tasks report per vector how many links they found and one vector of its local component,
never the pairs. Equal vectors are one point with a count from the start. So a group of
any size costs its points, not its pairs, in rows.

Defined results: null and zero vectors, and vectors with null or non-finite components or
another dimension than most, link with nothing. Repeated ids are vectors of their own;
they get the smallest id of their component as well (null ids come last).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .components import components

THRESHOLD = 0.95
# The bound of the sample that the top level is fitted on, and of its cells.
FIT_ROWS = 4096
MAX_CELLS = 512
# Vectors of a block, and on average of a cell.
BLOCK = 4096
# Slack for rounding in the bounds; single vectors have none.
SLACK = 1e-7
_BATCH = 2048


def link_radius(threshold: float) -> float:
    """Distance of unit vectors whose cosine is the threshold."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold)))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = np.asarray(vectors, np.float64)
    # The largest component comes out first, so that squares neither vanish nor overflow.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between all rows of two sets of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def greedy_centres(x: np.ndarray, radius: float, most: int) -> np.ndarray | None:
    """Rows no two of which are within the radius, and that cover all others; null if
    there would be more than ``most``."""
    left = np.arange(len(x))
    centres = []
    while len(left):
        if len(centres) == most:
            return None
        centres.append(left[0])
        left = left[distances(x[left[:1]], x[left])[0] > radius]
    return np.array(centres)


def top_centres(sample: np.ndarray, wanted: int) -> np.ndarray:
    """The wanted number of centres, of the largest radius that has so many.

    Radii halve from two; if a halving gives very many centres, radii between are tried.
    """
    low, high = 0.0, 2.0
    best = sample[:1]
    for _ in range(16):
        if len(best) >= wanted:
            break
        radius = (low + high) / 2
        found = greedy_centres(sample, radius, 4 * wanted)
        if found is None:
            low = radius
        else:
            best, high = sample[found], radius
    return best[:wanted]


def nested_levels(x: np.ndarray, radius: float) -> np.ndarray:
    """For each level and row the number of its node, levels from coarse to fine.

    Radii halve from two link radii to a quarter of one. The nodes of a level divide those
    of the one above.
    """
    levels = []
    node = np.zeros(len(x), np.int64)
    for power in range(1, -3, -1):
        reach = radius * 2.0**power
        finer = np.empty(len(x), np.int64)
        made = 0
        order = np.argsort(node, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
            while len(rows):
                near = np.ones(1, bool) if len(rows) == 1 else distances(x[rows[:1]], x[rows])[0] <= reach
                near[0] = True
                finer[rows[near]] = made
                made += 1
                rows = rows[~near]
        node = finer
        levels.append(node)
    return np.array(levels)


class Tree(NamedTuple):
    """The levels of a block. Per level: first row of each node, its covering radius, and
    rows in node order with the bounds of each node; children are the nodes within."""

    x: np.ndarray
    first: list[np.ndarray]
    radius: list[np.ndarray]
    parent: list[np.ndarray]


def build(x: np.ndarray, levels: np.ndarray) -> Tree:
    """The tree of one block; every single row is a node of the last level."""
    own = [*levels, np.arange(len(x))]
    firsts, radii, parents = [], [], []
    for depth, node in enumerate(own):
        _, first, node = np.unique(node, return_index=True, return_inverse=True)
        away = np.sqrt(np.maximum(((x - x[first][node]) ** 2).sum(1), 0))
        away[first] = 0
        radius = np.zeros(len(first))
        np.maximum.at(radius, node, away)
        firsts.append(first)
        radii.append(radius)
        parents.append(own[depth - 1][first] if depth else np.zeros(len(first), np.int64))
        own[depth] = node
    return Tree(x, firsts, radii, parents)


def _children(tree: Tree, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Children in order of their parent, and where each parent's begin."""
    parent = tree.parent[level + 1]
    order = np.argsort(parent, kind="stable")
    n = len(tree.first[level])
    return order, np.searchsorted(parent[order], np.arange(n + 1))


def _product(a: np.ndarray, b: np.ndarray, ca, cb) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of each pair of nodes."""
    (order_a, at_a), (order_b, at_b) = ca, cb
    na, nb = at_a[a + 1] - at_a[a], at_b[b + 1] - at_b[b]
    total = na * nb
    pair = np.repeat(np.arange(len(a)), total)
    k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    return order_a[at_a[a][pair] + k // nb[pair]], order_b[at_b[b][pair] + k % nb[pair]]


class _Groups:
    """Union-find over the rows of two blocks."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)


# Pairs of nodes that are looked at together.
_FRONT = 1 << 15


def dual_traversal(
    a: Tree, b: Tree, na: np.ndarray, nb: np.ndarray, threshold: float, same: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between the rows of two trees, or within one if ``same``.

    ``na`` and ``nb`` are how many vectors each row stands for. Returns the numbers of
    vectors that each row of a and of b links with, and a group number for all rows of a
    and then b: rows have one group if links among these rows connect them.
    """
    radius = link_radius(threshold)
    depth = len(a.first) - 1
    n = len(a.x)
    groups = _Groups(n if same else n + len(b.x))
    links_a, links_b = np.zeros(n, np.int64), np.zeros(len(b.x), np.int64)
    shift = 0 if same else n
    below = [_rows_below(t) for t in (a, b)]
    children = [[_children(t, k) for k in range(depth)] for t in (a, b)]

    def link_whole(i: int, j: int, level: int) -> None:
        rows_a, rows_b = below[0][level](i), below[1][level](j)
        if same and i == j:
            links_a[rows_a] += na[rows_a].sum() - na[rows_a]
        else:
            links_a[rows_a] += nb[rows_b].sum()
            target = links_a if same else links_b
            target[rows_b] += na[rows_a].sum()
        for x in rows_a:
            groups.join(int(x), int(rows_a[0]))
        for x in rows_b:
            groups.join(int(x) + shift, int(rows_a[0]))

    def visit(i: np.ndarray, j: np.ndarray, level: int) -> None:
        for at in range(0, len(i), _FRONT):
            one, two = i[at : at + _FRONT], j[at : at + _FRONT]
            xa, xb = a.x[a.first[level][one]], b.x[b.first[level][two]]
            if level == depth:
                cosine = np.einsum("ij,ij->i", xa, xb)
                hit = cosine >= threshold
                single(one[hit], two[hit])
                continue
            gap = np.sqrt(((xa - xb) ** 2).sum(1))
            settle(one, two, gap, level)

    def settle(one: np.ndarray, two: np.ndarray, gap: np.ndarray, level: int) -> None:
        reach = a.radius[level][one] + b.radius[level][two]
        inside = gap + reach <= radius - SLACK
        for x, y in zip(one[inside].tolist(), two[inside].tolist()):
            link_whole(x, y, level)
        going = ~inside & (gap - reach <= radius + SLACK)
        one, two = one[going], two[going]
        sizes = _sizes(one, two, children, level)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // _FRONT)) + 1
        for p, q, k in zip(np.split(one, cuts), np.split(two, cuts), np.split(sizes, cuts)):
            x, y = _product(p, q, children[0][level], children[1][level])
            if same:
                # A node against itself gives each pair of children once.
                once = x <= y if level + 1 < depth else x < y
                keep = once | np.repeat(p != q, k)
                x, y = x[keep], y[keep]
            visit(x, y, level + 1)

    def single(one: np.ndarray, two: np.ndarray) -> None:
        ra, rb = a.first[depth][one], b.first[depth][two]
        np.add.at(links_a, ra, nb[rb])
        np.add.at(links_a if same else links_b, rb, na[ra])
        for x, y in zip(ra.tolist(), rb.tolist()):
            groups.join(x, y + shift)

    # The top level of a block is compared as a matrix, some rows at a time.
    top_a, top_b = a.x[a.first[0]], b.x[b.first[0]]
    widest = b.radius[0].max(initial=0.0)
    for at in range(0, len(top_a), 1024):
        part = top_a[at : at + 1024]
        bound = radius + SLACK + a.radius[0][at : at + 1024] + widest
        # A lower cosine than this is farther than the bound.
        least = 1 - np.minimum(bound, 2) ** 2 / 2 - SLACK
        one, two = np.nonzero(part @ top_b.T >= least[:, None])
        one = one + at
        if same:
            one, two = one[one <= two], two[one <= two]
        gap = np.sqrt(((top_a[one] - top_b[two]) ** 2).sum(1))
        settle(one, two, gap, 0)
    roots = np.array([groups.root(i) for i in range(len(groups.parent))], np.int64)
    return links_a, links_b, roots


def _sizes(p: np.ndarray, q: np.ndarray, children, level: int) -> np.ndarray:
    at_a, at_b = children[0][level][1], children[1][level][1]
    return (at_a[p + 1] - at_a[p]) * (at_b[q + 1] - at_b[q])


def _rows_below(tree: Tree) -> list:
    """For each level, a function from a node to the rows under it."""
    out = []
    node = np.arange(len(tree.x))
    own = [node]
    for level in range(len(tree.first) - 1, 0, -1):
        own.append(tree.parent[level][own[-1]])
    for node in reversed(own):
        order = np.argsort(node, kind="stable")
        bounds = np.searchsorted(node[order], np.arange(node.max(initial=-1) + 2))
        out.append(lambda i, o=order, s=bounds: o[s[i] : s[i + 1]])
    return out


def _vectors(batch: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch), kind).reshape(len(batch), -1)


def _points(embeddings: DataFrame, vec_id: str, column: str) -> tuple[DataFrame, str]:
    """Written ``id, vec`` of all rows, ``vec`` null where it cannot link; and the type of
    its components."""
    kind = "<f4" if "array<float>" in dict(embeddings.dtypes)[column] else "<f8"
    rows = embeddings.select(F.col(vec_id).alias("id"), F.col(column).alias("embedding"))
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    sizes = rows.where(usable).groupBy(F.size("embedding").alias("size")).count()
    # The most common dimension; one row per dimension.
    common = sizes.orderBy(F.desc("count"), "size").first()
    dimension = common["size"] if common else 0

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[bytes | None] = []
            for v in batch:
                x = None if v is None or len(v) != dimension else np.array(v, kind)
                fine = x is not None and np.isfinite(x).all() and x.any()
                out.append(x.tobytes() if fine else None)
            yield pd.Series(out)

    whole = usable & ~F.exists("embedding", lambda x: x.isNull())
    return written(rows.select("id", F.when(whole, packed("embedding")).alias("vec")), "vectors"), kind


def near_duplicates(
    embeddings: DataFrame,
    threshold: float = THRESHOLD,
    vec_id: str = "vec_id",
    column: str = "embedding",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    spark = embeddings.sparkSession
    small_batches(spark, _BATCH)
    rows, kind = _points(embeddings, vec_id, column)
    known = rows.where("vec is not null").groupBy("vec").agg(F.count(F.lit(1)).alias("n"))
    points = written(known.withColumn("point", F.monotonically_increasing_id()), "points")
    total = points.count()
    radius = link_radius(threshold)

    sample = points.orderBy(F.xxhash64("vec")).limit(FIT_ROWS).select("vec").collect() if total else []
    centres = np.zeros((0, 1))
    if total:
        centres = unit(_vectors(pd.Series([r.vec for r in sample]), kind))
        centres = top_centres(centres, min(MAX_CELLS, -(-total // BLOCK)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            gaps = distances(unit(_vectors(batch["vec"], kind)), centres)
            cell = gaps.argmin(1)
            yield batch.assign(cell=cell.astype(np.int32), gap=gaps[np.arange(len(cell)), cell])

    placed = points.mapInPandas(assign, "vec binary, n long, point long, cell int, gap double")
    placed = written(placed, "cells")
    # One row per cell.
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("gap")).collect()
    covering = np.zeros(len(centres))
    first_unit, units = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
    made = 0
    for r in sorted(cells):
        covering[r.cell], first_unit[r.cell], units[r.cell] = r.gap, made, -(-r.n // BLOCK)
        made += -(-r.n // BLOCK)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["cell"].to_numpy()
            # Points are numbered at random with respect to their content.
            unit_of = first_unit[own] + batch["point"].to_numpy() % 1_000_003 % units[own]
            yield batch.assign(unit=unit_of.astype(np.int32))[["point", "vec", "n", "cell", "unit"]]

    divided = placed.mapInPandas(spread, "point long, vec binary, n long, cell int, unit int")

    def level(block: pd.DataFrame) -> pd.DataFrame:
        levels = nested_levels(unit(_vectors(block["vec"], kind)), radius).astype("<i4")
        return block.assign(levels=[x.tobytes() for x in levels.T])

    schema = "point long, vec binary, n long, cell int, unit int, levels binary"
    blocks = written(divided.groupBy("unit").applyInPandas(level, schema), "blocks")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = unit(_vectors(batch["vec"], kind))
            # The bound of a vector against a cell.
            near = distances(x, centres) <= covering + radius + SLACK
            near[np.arange(len(x)), batch["cell"]] = True
            lists = [
                np.concatenate([first_unit[c] + np.arange(units[c]) for c in np.flatnonzero(row)])
                for row in near
            ]
            yield batch.assign(partners=lists)[["point", "vec", "n", "unit", "levels", "partners"]]

    schema = "point long, vec binary, n long, unit int, levels binary, partners array<int>"
    meeting = blocks.mapInPandas(meet, schema).withColumn("partner", F.explode("partners"))
    meeting = meeting.withColumns({"low": F.least("unit", "partner"), "high": F.greatest("unit", "partner")})

    def match(key: tuple[int, int], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point", ignore_index=True)
        sides = [rows[rows["unit"] == u] for u in dict.fromkeys(key)]
        if min(map(len, sides)) == 0:
            return pd.DataFrame({"point": [], "links": [], "root": []})
        trees = [
            build(
                unit(_vectors(s["vec"], kind)),
                np.frombuffer(b"".join(s["levels"]), "<i4").reshape(len(s), -1).T.astype(np.int64),
            )
            for s in sides
        ]
        weights = [s["n"].to_numpy() for s in sides]
        same = len(sides) == 1
        one, two, roots = dual_traversal(
            trees[0], trees[-1], weights[0], weights[-1], threshold, same
        )
        links = one if same else np.concatenate([one, two])
        points = pd.concat(sides)["point"].to_numpy()
        hit = links > 0
        return pd.DataFrame({"point": points[hit], "links": links[hit], "root": points[roots[hit]]})

    meeting = meeting.select("point", "vec", "n", "unit", "levels", "low", "high")
    matched = meeting.groupBy("low", "high").applyInPandas(match, "point long, links long, root long")
    matched = written(matched, "matches")
    links = matched.groupBy("point").agg(F.sum("links").alias("links"))
    edges = matched.select(F.col("point").alias("a"), F.col("root").alias("b"))
    parts = components(edges).withColumnRenamed("node", "point")

    named = points.join(links, "point", "left").join(parts, "point", "left").select(
        "vec",
        F.coalesce("component", "point").alias("part"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
    )
    found = written(rows.where("vec is not null").join(named, "vec").drop("vec"), "linked")
    least = found.groupBy("part").agg(F.min("id").alias("component_id"))
    linked = found.join(least, "part").select("id", "n_links", "component_id")
    alone = rows.where("vec is null").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    return linked.unionByName(alone).select(
        F.col("id").alias("vec_id"),
        "n_links",
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
