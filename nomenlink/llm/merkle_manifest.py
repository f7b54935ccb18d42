"""A Merkle manifest of a dataset, its proofs, and their verification.

Every row is a leaf, the leaves of a language form a tree of runs of ``RUN`` nodes, and
the subroots of the languages form one more tree above them. A digest is the lowercase
hex SHA-256 of the concatenated hex digests below it; that of a row covers the five
columns ``doc_id, source, lang, n_chars, text``, each as its byte count, a colon and its
value, or a dash for a null.

* Leaf digests are made where the rows are read; texts never shuffle. Leaves get their
  place in their tree from a range partitioning and one count per partition and tree.
* The nodes below one node ``HEIGHT`` levels up are a superblock. Each is reduced to one node in a
  group of its own, and the nodes of all superblocks are the leaves of the next tier,
  until every tree has a single node. So a tree of any size costs one small group per
  superblock and a few tiers.
* On the way down, the nodes of a superblock are cogrouped with the outer nodes that its
  proofs need: the siblings on the path from the superblock to the root, one row per
  superblock. That group finishes the local levels, joins local and outer siblings to
  whole proofs, and folds a claimed leaf along each proof to a root.

Defined results: a null language is a tree of its own, before all others; a null doc_id
comes first in its tree. Repeated rows are leaves of their own next to each other; which
of them stands first shows in nothing but their proofs, which are interchangeable. Empty
texts count as zero bytes, and a text of any length is hashed where it is read. An empty
table has no root and gives no rows. Other columns are no part of a leaf. A missing one of
the five is an error.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import BROADCAST_BYTES
from ..sources.staging import stage
from .common import written

# Nodes of a run, and levels of a superblock.
RUN = 8
HEIGHT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(*values: Column) -> Column:
    """The digest of a leaf with these values in order."""
    parts = []
    for value in values:
        text = value.cast("string")
        framed = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(framed, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def join_digest(digests: list[str]) -> str:
    """The digest of a run of nodes."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_above(digests: list[str], size: int, height: int) -> list[list[str]]:
    """The levels of a superblock from its nodes up, as far as it or its tree reaches.

    ``size`` is the number of nodes that the whole tree has in the lowest of them.
    """
    levels = [digests]
    while size > 1 and len(levels) <= height:
        below = levels[-1]
        levels.append([join_digest(below[i : i + RUN]) for i in range(0, len(below), RUN)])
        size = -(-size // RUN)
    return levels


def siblings(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """By level, the joined digests before and after a node in its run."""
    before, after = [], []
    for level in levels[:-1]:
        start = at - at % RUN
        before.append("".join(level[start:at]))
        after.append("".join(level[at + 1 : start + RUN]))
        at //= RUN
    return before, after


def fold(leaf: str, before: list[str], after: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for low, high in zip(before, after):
        leaf = hashlib.sha256(f"{low}{leaf}{high}".encode()).hexdigest()
    return leaf


def _placed(rows: DataFrame) -> DataFrame:
    """Add ``pos`` and ``size``: a row's place in its ``tree`` and the tree's rows.

    Rows stand in the order of ``present, id, digest``. The written row number
    makes equal rows different, so that range partitioning can part them.
    """
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    order = ("tree", "present", "id", "digest", "_row")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The generated id holds the partition in its upper bits, the place in the lower 33.
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33).alias("_part")
    spans = ranged.groupBy("tree", part).agg(
        F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_rows")
    )
    # A tree has as many rows here as partitions hold some of its rows.
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "tree", "_part",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_low")).alias("_shift"),
        F.sum("_rows").over(tree).alias("size"),
    )
    spans = stage(spans, "spans")
    # One row per tree and partition; beyond the limit both sides shuffle, and no key of
    # that join has more rows than one partition held.
    found = F.broadcast(spans.frame) if spans.size <= BROADCAST_BYTES else spans.frame
    placed = ranged.withColumn("_part", part).join(found, ["tree", "_part"])
    return placed.withColumn("pos", F.col("_at") + F.col("_shift")).drop(
        "_row", "_at", "_part", "_shift"
    )


def _in_blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / RUN**height).cast("long"))


def _reduced(nodes: DataFrame, height: int) -> DataFrame:
    """The next tier: one node per superblock."""

    def top(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        size = int(group["size"].iloc[0])
        levels = levels_above(group["digest"].tolist(), size, height)
        return pd.DataFrame(
            {
                "tree": group["tree"].iloc[:1],
                "pos": group["block"].iloc[:1],
                "size": -(-size // RUN**height),
                "digest": levels[-1],
            }
        )

    nodes = nodes.select("tree", "pos", "size", "digest")
    blocks = _in_blocks(nodes, height).groupBy("tree", "block")
    return blocks.applyInPandas(top, "tree string, pos long, size long, digest string")


class Tiers(NamedTuple):
    """The nodes of some trees: those given, and those of every tier above."""

    nodes: DataFrame
    above: list[DataFrame]

    def tops(self) -> DataFrame:
        """``tree, digest``: the root of every tree."""
        return self.above[-1].select("tree", "digest")


def build(nodes: DataFrame, height: int = HEIGHT) -> Tiers:
    """Reduce ``tree, pos, size, digest`` rows until every tree has one node."""
    above = [written(_reduced(nodes, height), "tier")]
    while (above[-1].agg(F.max("size")).first()[0] or 0) > 1:
        above.append(written(_reduced(above[-1], height), "tier"))
    return Tiers(nodes, above)


_OUTER = "before array<string>, after array<string>, subroot string, root string"


def _outer_to(nodes: DataFrame, outer: DataFrame, height: int) -> DataFrame:
    """The outer nodes of every node, from those of the superblocks: a tier further down."""

    def down(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        levels = levels_above(group["digest"].tolist(), int(group["size"].iloc[0]), height)
        path = above.iloc[0]
        rows = []
        for at, pos in enumerate(group["pos"]):
            before, after = siblings(levels, at)
            rows.append((pos, before + list(path["before"]), after + list(path["after"])))
        made = pd.DataFrame(rows, columns=["pos", "before", "after"])
        return made.assign(tree=path["tree"], subroot=path["subroot"], root=path["root"])

    nodes = nodes.select("tree", "pos", "size", "digest")
    return _cogrouped(nodes, outer, height).applyInPandas(
        down, "tree string, pos long, " + _OUTER
    )


def _cogrouped(nodes: DataFrame, outer: DataFrame, height: int):
    """The nodes of every superblock together with its outer nodes."""
    outer = outer.withColumnRenamed("pos", "block")
    return _in_blocks(nodes, height).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))


def _outer_of_tops(subroots: DataFrame, height: int) -> DataFrame:
    """The outer nodes of every whole tree: its siblings in the tree of the subroots."""
    named = subroots.select(
        F.lit("").alias("tree"), F.lit(True).alias("present"), F.col("tree").alias("id"), "digest"
    )
    placed = written(_placed(named), "subroots")
    upper = build(placed, height)
    none = F.array().cast("array<string>")
    outer = upper.above[-1].select(
        "tree", "pos", none.alias("before"), none.alias("after"),
        F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"),
    )
    for nodes in [*reversed(upper.above[:-1]), upper.nodes]:
        outer = _outer_to(nodes, outer, height)
    # Back to the names of the trees, which have one node each.
    return placed.join(outer.drop("tree", "subroot"), "pos").select(
        F.col("id").alias("tree"), F.lit(0).cast("long").alias("pos"),
        "before", "after", F.col("digest").alias("subroot"), "root",
    )


def manifest(
    docs: DataFrame,
    claimed: dict[str, Column] | None = None,
    with_proofs: bool = False,
    height: int = HEIGHT,
) -> DataFrame:
    """One row per document, with its leaf, the roots above it, and a check of a claim.

    ``claimed`` replaces columns by what someone claims they hold; the leaf of the claim is
    folded along the siblings of the true one, and ``verified`` says whether that leads to
    the root. Gives ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``,
    and with ``with_proofs`` the siblings themselves: ``before`` and ``after``, by level.
    """
    missing = [c for c in FIELDS if c not in docs.columns]
    if missing:
        raise ValueError(f"the documents lack the columns {missing}")
    own = [F.col(c) for c in FIELDS]
    other = [(claimed or {}).get(c, F.col(c)) for c in FIELDS]
    rows = docs.select(
        # Nulls sort before all names, and names in the order of their bytes.
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").isNotNull().alias("present"),
        F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("id"),
        digest_of(*own).alias("digest"),
        (digest_of(*other) if claimed else F.lit(None).cast("string")).alias("claim"),
    )
    leaves = _placed(rows)
    tiers = build(leaves, height)
    outer = _outer_of_tops(tiers.tops(), height)
    for nodes in reversed(tiers.above[:-1]):
        outer = _outer_to(nodes, outer, height)
    outer = written(outer, "outer")

    def finish(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        digests = group["digest"].tolist()
        levels = levels_above(digests, int(group["size"].iloc[0]), height)
        path = above.iloc[0]
        more_before, more_after = list(path["before"]), list(path["after"])
        outer_proof = "".join(b + a for b, a in zip(more_before, more_after))
        proofs, folded, befores, afters = [], [], [], []
        for at, claim in enumerate(group["claim"]):
            before, after = siblings(levels, at)
            proof = "".join(b + a for b, a in zip(before, after)) + outer_proof
            proofs.append(hashlib.sha256(proof.encode()).hexdigest())
            before, after = before + more_before, after + more_after
            folded.append(fold(digests[at] if claim is None else claim, before, after))
            if with_proofs:
                befores.append(before)
                afters.append(after)
        made = pd.DataFrame(
            {
                "present": group["present"], "id": group["id"], "leaf": digests,
                "subroot": path["subroot"], "root": path["root"],
                "proof_sha256": proofs, "folded_root": folded,
            }
        )
        if with_proofs:
            made = made.assign(before=befores, after=afters)
        return made.assign(verified=made["folded_root"] == made["root"])

    kind = leaves.schema["id"].dataType.simpleString()
    schema = (
        f"present boolean, id {kind}, leaf string, subroot string, root string, "
        "proof_sha256 string, folded_root string, verified boolean"
    )
    if with_proofs:
        schema += ", before array<string>, after array<string>"
    made = _cogrouped(leaves, outer, height).applyInPandas(finish, schema)
    return made.select(
        F.when(F.col("present"), F.col("id")).alias("doc_id"),
        *(c for c in made.columns if c not in ("present", "id")),
    )


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text with A-Z lower-cased where 3 divides the CRC-32 of the id as text."""
    hit = F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 0, F.lit(False))
    return F.when(hit, F.translate(text, _UPPER, _LOWER)).otherwise(text)
