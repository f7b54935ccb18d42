"""The manifest against a plain version that holds all leaves in lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from nomenlink.llm import merkle_manifest as mm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    fields = (row[0], row[3], row[2], row[4], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def plain_tree(digests):
    """The root, and for each leaf its (before, after) strings by level."""
    paths = [[] for _ in digests]
    at = list(range(len(digests)))
    level = list(digests)
    while len(level) > 1:
        for i, p in enumerate(at):
            low = p - p % 8
            paths[i].append(("".join(level[low:p]), "".join(level[p + 1 : low + 8])))
            at[i] = p // 8
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], paths


def plain(rows):
    """Sorted result rows."""
    trees = {}
    for row in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[1] or "")
        hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
        claim = leaf_of(row, lowered if hit and row[1] is not None else row[1])
        trees.setdefault(row[2], []).append((row[0], leaf_of(row, row[1]), claim))
    names = sorted(trees, key=lambda n: b"" if n is None else b"=" + n.encode())
    made = []
    for name in names:
        leaves = sorted(trees[name], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        made.append((leaves, *plain_tree([x[1] for x in leaves])))
    root, upper = plain_tree([subroot for _, subroot, _ in made])
    out = []
    for (leaves, subroot, paths), above in zip(made, upper):
        for (doc_id, leaf, claim), path in zip(leaves, paths):
            steps = path + above
            proof = sha("".join(a + b for a, b in steps))
            for a, b in steps:
                claim = sha(a + claim + b)
            out.append((doc_id, leaf, subroot, root, proof, claim, claim == root))
    return sorted(out, key=str)


def digest(frame, height=mm.HEIGHT):
    claim = {"text": mm.tampered_text(F.col("doc_id"), F.col("text"))}
    return sorted(map(tuple, mm.manifest(frame, claim, height=height).collect()), key=str)


def rows_of(n, lang):
    return [(i, f"Text Nr. {i}", lang, "src", i * 7) for i in range(n)]


EDGES = [
    (1, None, "en", "s", 0), (2, "", "en", None, None), (None, "Null id", "en", "s", 1),
    (3, "Repeated", "en", "s", 8), (3, "Repeated", "en", "s", 8), (3, "Tie", "en", "s", 8),
    (4, "É ß 日本", None, "s", 7), (5, "Lone", "", "s", 4), (6, "Lone", "zz", "s", 4),
    (7, "X" * 500_000, "en", "s", 1), (-9, "ABC", "Ünï", "s", 3),
]


@pytest.mark.parametrize(
    "rows",
    [EDGES, rows_of(1, "en"), rows_of(8, "en"), rows_of(9, None) + rows_of(65, "fr"),
     [(i, "T", f"lang{i % 77}", None, None) for i in range(300)]],
    ids=["edges", "one", "run", "two", "many trees"],
)
def test_equals_the_plain_version(spark, rows):
    assert digest(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


@pytest.mark.parametrize("height", [1, 2])
def test_small_superblocks_give_the_same(spark, height):
    rows = rows_of(700, "en") + rows_of(64, "fr") + rows_of(65, "de") + EDGES
    assert digest(spark.createDataFrame(rows, SCHEMA), height) == plain(rows)


def test_whole_superblocks(spark):
    rows = rows_of(mm.RUN**mm.HEIGHT * 3 + 1, "en") + rows_of(mm.RUN**mm.HEIGHT, "fr")
    assert digest(spark.createDataFrame(rows, SCHEMA).repartition(7)) == plain(rows)


def test_repeated_rows_hold_a_third(spark):
    rows = rows_of(400, "en") + [(7, "Same", "en", "src", 4)] * 200
    found = digest(spark.createDataFrame(rows, SCHEMA))
    # Equal leaves may share out their proofs in any way.
    assert found == plain(rows)


def test_empty_table_and_clashing_names(spark):
    assert digest(spark.createDataFrame([], SCHEMA)) == []
    rows = rows_of(20, "en")
    clash = spark.createDataFrame(rows, SCHEMA)
    for name in ("tree", "pos", "size", "digest", "block", "claim", "id", "present", "leaf", "root"):
        clash = clash.withColumn(name, F.lit("x"))
    assert digest(clash) == plain(rows)
    with pytest.raises(ValueError):
        mm.manifest(spark.createDataFrame(rows, SCHEMA).drop("source"))


def test_text_ids_and_proofs(spark):
    rows = [(f"d{i}", f"T{i}", "en", "s", 1) for i in range(30)]
    frame = spark.createDataFrame(rows, SCHEMA.replace("doc_id long", "doc_id string"))
    for row in mm.manifest(frame, with_proofs=True).collect():
        assert row.verified and row.folded_root == row.root
        assert mm.fold(row.leaf, row.before, row.after) == row.root
        assert mm.fold(sha("other"), row.before, row.after) != row.root
        proof = "".join(b + a for b, a in zip(row.before, row.after))
        assert sha(proof) == row.proof_sha256
