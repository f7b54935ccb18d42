"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its runs of five words (lower-cased, split at white space). The
weight of a shingle is its count times the mean IDF of its words. IDF comes from the
document frequencies of all words in all documents; words rarer than a floor share the
floor's IDF, which bounds the table that workers get (see ``idf_table``).

Consistent weighted sampling draws ``BANDS * ROWS`` samples of each text, such that two
texts agree on a sample with the probability of their weighted Jaccard similarity. Texts
that agree on a whole band meet in a bucket. A bucket proposes pairs in two passes:

1. Each text is paired with the text before it in its bucket that agrees with it on most
   samples, if those are at least ``ALIKE`` of all. So a group of copies proposes one pair
   per text, not all pairs. The pairs are verified and give components.
2. Buckets that still have several components get the shingles of their texts. Their
   tasks verify all pairs of different components that share a band, but for those whose
   total weights alone rule out a link, and give back the links that connect components,
   not the pairs.

Every link is verified by the exact weighted Jaccard similarity of whole texts. A pair of
0.8 exactly misses every band with a probability of 0.0002, which falls steeply above.
Large buckets are worked on in blocks; no pair of a band is left out.

Texts of equal word sequences are one node from the start, whatever their number.

Defined results: a null or wordless text is linked with nothing, not even its copies; a
text of one to four words has one shingle. Repeated rows are copies of each other. Of a
class the lowest doc_id is kept (null last), and one row of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (
    doc_id,
    forget_with,
    mix64,
    small_batches,
    sorted_groups,
    tidy,
    with_key,
    written,
)
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 16
ROWS = 4
# Samples that two texts must share to be proposed as partners in the first pass: four
# deviations below the mean at 0.8. The second pass compares what was not proposed.
ALIKE = 38
# Texts of a bucket that one task compares by samples, and by shingles with as many others.
BLOCK = 2048
SET_BLOCK = 1024
# Words with a document frequency below one document in so many share one IDF.
RARE = 1000
# Upper bound of the words in the IDF table, kept by raising the floor above.
TABLE_WORDS = 500_000
# Node lists up to this size in bytes are broadcast to pick the texts to verify.
BROADCAST_BYTES = 16 << 20

_SAMPLES = BANDS * ROWS
# Words that a worker remembers the hashes of, and words that it holds to count.
_REMEMBERED = 100_000
_COUNTED = 1_000_000
_ENTRIES = 1 << 16


class _WordHashes(dict):
    """Hashes of words, remembered in bounded memory."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _WordHashes()
forget_with(_HASHES.clear)


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word of the text."""
    words = (text or "").lower().split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


class Idf(NamedTuple):
    """Sorted hashes of frequent words with their IDF, and the IDF of all others."""

    words: np.ndarray
    values: np.ndarray
    rare: float

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashes), self.rare)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.values[at], self.rare)


def idf_table(docs: DataFrame) -> Idf:
    """IDF of words from the document frequencies over all documents.

    The floor of the frequency is a thousandth of the documents, or as much more as keeps
    the frequent words below ``TABLE_WORDS``: so many words at most can have a frequency
    above the sum of all frequencies divided by that number.
    """
    small_batches(docs.sparkSession)

    @tidy
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = n_docs = 0

        def told() -> pd.DataFrame:
            words, df = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"word": words.view(np.int64), "df": df, "docs": 0})

        for batch in batches:
            for text in batch["text"]:
                own = np.unique(word_hashes(text))
                n_docs += len(own) > 0
                held.append(own)
                size += len(own)
            if size > _COUNTED:
                yield told()
                held, size = [], 0
        if held:
            yield told()
        yield pd.DataFrame({"word": [0], "df": [0], "docs": [n_docs]})

    counted = written(
        docs.select("text")
        .mapInPandas(count, "word long, df long, docs long")
        .groupBy("word")
        .agg(F.sum("df").alias("df"), F.sum("docs").alias("docs")),
        "word_counts",
    )
    total = counted.agg(F.sum("df").alias("df"), F.sum("docs").alias("docs")).first()
    n = total.docs or 0
    if not n:
        return Idf(np.zeros(0, np.uint64), np.zeros(0), 1.0)
    floor = max(n / RARE, total.df / TABLE_WORDS, 1.0)
    frequent = counted.where(F.col("df") > floor).select("word", "df").toPandas()
    words = frequent["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    df = frequent["df"].to_numpy(float)[order]
    return Idf(words[order], np.log1p(n / df), float(np.log1p(n / floor)))


def shingles(hashes: np.ndarray, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order, and their weights."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0)
    width = min(SHINGLE, n)
    weight = idf.of(hashes)
    joint = np.zeros(n - width + 1, np.uint64)
    total = np.zeros(n - width + 1)
    for k in range(width):
        part = slice(k, n - width + 1 + k)
        joint = mix64(joint ^ hashes[part])
        total += weight[part]
    keys, at = np.unique(joint, return_inverse=True)
    # Equal shingles have equal words, so the sum is the count times the mean IDF.
    return keys, np.bincount(at, total / width, len(keys))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle sets; 0 if one is empty."""
    (ka, wa), (kb, wb) = a, b
    if not len(ka) or not len(kb):
        return 0.0
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    both = kb[at] == ka
    common = np.minimum(wa[both], wb[at[both]]).sum()
    return float(common / (wa.sum() + wb.sum() - common))


class Sampler:
    """Improved consistent weighted sampling with variates from a fixed table.

    For each sample a hash maps a shingle to one of 65,536 drawn triples (r, c, beta),
    with r and c from Gamma(2, 1) and beta uniform. The shingle of least a = c / (y e^r)
    is the sample, together with t = floor(ln weight / r + beta), where y = e^(r (t - beta)).
    Shingles that share a triple are told apart by their hash.
    """

    def __init__(self) -> None:
        drawn = np.random.Generator(np.random.PCG64(20240229))
        self.r = drawn.gamma(2.0, 1.0, _ENTRIES).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.beta = drawn.random(_ENTRIES).astype(np.float32)
        self.ln_c = np.log(drawn.gamma(2.0, 1.0, _ENTRIES)).astype(np.float32)
        self.factors = mix64(np.arange(1, _SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)

    def sample(self, keys: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The samples (rows) of the non-empty texts that start at ``starts``."""
        out = np.empty((len(starts), _SAMPLES), np.uint32)
        ln_w = np.log(weights).astype(np.float32)
        low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for k in range(_SAMPLES):
            with np.errstate(over="ignore"):
                at = ((keys * self.factors[k]) >> np.uint64(48)).astype(np.intp)
                r, beta = self.r[at], self.beta[at]
                t = np.floor(ln_w * self.inverse[at] + beta)
                ln_a = self.ln_c[at] - r * (t - beta + np.float32(1))
                name = low + t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
                name *= np.uint32(2 * k + 1)
            bits = _sortable(ln_a)
            packed = (bits.astype(np.uint64) << np.uint64(32)) | name
            out[:, k] = np.minimum.reduceat(packed, starts).astype(np.uint32)
        return out


def _sortable(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the floats."""
    bits = x.view(np.int32)
    return (bits ^ ((bits >> 31) | np.int32(-(2**31)))).view(np.uint32)


def _band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and text."""
    out = np.empty((len(samples), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(samples), band + 1, np.uint64)
        for row in range(ROWS):
            key = mix64(key ^ samples[:, band * ROWS + row])
        out[:, band] = key
    return out


def _node(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a word sequence."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


@F.pandas_udf(T.BinaryType())
@tidy
def _node_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        hashes = [word_hashes(t) for t in batch]
        yield pd.Series([_node(h) if len(h) else None for h in hashes])


def _signatures(docs: DataFrame, idf) -> DataFrame:
    """``doc_id, node, bands, samples``; null but for the id where a text has no word."""
    keyed = with_key(docs, "text")

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler()
        for batch in batches:
            hashes = [word_hashes(t) for t in batch["text"]]
            sets = [shingles(h, idf.value) for h in hashes if len(h)]
            nodes, bands, samples = ([None] * len(hashes) for _ in range(3))
            if sets:
                starts = np.cumsum([0] + [len(k) for k, _ in sets[:-1]])
                found = sampler.sample(
                    np.concatenate([k for k, _ in sets]),
                    np.concatenate([w for _, w in sets]),
                    starts,
                )
                keys = _band_keys(found).view(np.int64)
                short = mix64(found.astype(np.uint64)).astype(np.uint16)
                for row, at in enumerate(i for i, h in enumerate(hashes) if len(h)):
                    nodes[at] = _node(hashes[at])
                    bands[at] = keys[row].tolist()
                    samples[at] = short[row].tobytes()
            key = {"absent": batch["absent"], "id": batch["id"]}
            yield pd.DataFrame({**key, "node": nodes, "bands": bands, "samples": samples})

    found = keyed.mapInPandas(
        run,
        f"absent boolean, id {dict(keyed.dtypes)['id']}, node binary, bands array<bigint>, "
        "samples binary",
    )
    return found.select(doc_id(), "node", "bands", "samples")


def _matrix(samples: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(samples), np.uint16).reshape(-1, _SAMPLES)


_PAIR = "a binary, b binary"


@tidy
def _best_before(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pair each text of a bucket block with the one before that agrees most with it."""
    pairs: list[tuple[bytes, bytes]] = []
    for group in sorted_groups(batches, ["bucket", "block"]):
        samples, nodes = _matrix(group["samples"]), group["node"]
        for i in range(1, len(nodes)):
            agreed = (samples[:i] == samples[i]).sum(1)
            best = int(agreed.argmax())
            if agreed[best] >= ALIKE:
                pairs.append((nodes[i], nodes[best]))
        if len(pairs) > 50_000:
            yield pd.DataFrame(set(pairs), columns=["a", "b"])
            pairs = []
    yield pd.DataFrame(set(pairs), columns=["a", "b"])


@tidy
def _links_across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between components of a bucket, within one block or between two.

    Texts of the largest component are compared with the others only, and texts that
    links found so far connect are not compared again.
    """
    for group in sorted_groups(batches, ["bucket", "block", "other"]):
        order = np.argsort(group["node"], kind="stable")
        group = {c: v[order] for c, v in group.items()}
        samples, nodes = _matrix(group["samples"]), group["node"]
        _, part = np.unique(group["component"], return_inverse=True)
        within = group["block"][0] == group["other"][0]
        side = group["side"]
        others = np.flatnonzero(part != np.bincount(part).argmax())
        total = np.array([np.frombuffer(w).sum() for w in group["weights"]])
        done = np.zeros(len(nodes), bool)
        links = []
        for i in others.tolist():
            done[i] = True
            agreed = samples == samples[i]
            # No similarity exceeds the ratio of the total weights.
            ratio = np.minimum(total, total[i]) / np.maximum(total, total[i])
            able = (part != part[i]) & ~done & (ratio >= THRESHOLD - 1e-6)
            if not within:
                able &= side != side[i]
            # A pair that agrees on several bands is compared in the first of them.
            bands = agreed.reshape(len(nodes), BANDS, ROWS).all(2)
            able &= bands[:, : group["band"][0]].sum(1) == 0
            mine = None
            for j in np.flatnonzero(able).tolist():
                if part[i] == part[j]:
                    continue
                mine = mine or _set_of(group, i)
                if similarity(mine, _set_of(group, j)) >= THRESHOLD - 1e-9:
                    links.append((nodes[i], nodes[j]))
                    part[part == part[j]] = part[i]
        yield pd.DataFrame(links, columns=["a", "b"])


def _set_of(group: dict[str, np.ndarray], i: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(group["keys"][i], np.uint64), np.frombuffer(group["weights"][i])


def _shingle_sets(keyed: DataFrame, wanted: DataFrame, idf) -> DataFrame:
    """Written ``node, keys, weights`` of the wanted nodes.

    ``wanted`` has ``node, absent, id``, the key of a row that has the node.
    """

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, keys, weights = [], [], []
            for text in batch["text"]:
                hashes = word_hashes(text)
                own, weight = shingles(hashes, idf.value)
                nodes.append(_node(hashes))
                keys.append(own.tobytes())
                weights.append(weight.tobytes())
            yield pd.DataFrame({"node": nodes, "keys": keys, "weights": weights})

    wanted = written(wanted, "wanted")
    rows = wanted.select("absent", "id").distinct()
    small = wanted.count() * 64 <= BROADCAST_BYTES
    found = keyed.join(F.broadcast(rows) if small else rows, ["absent", "id"], "left_semi")
    sets = found.select("text").mapInPandas(run, "node binary, keys binary, weights binary")
    # Rows of one id can have other texts.
    sets = sets.join(F.broadcast(wanted.select("node")) if small else wanted.select("node"), "node", "left_semi")
    return written(sets.dropDuplicates(["node"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of at least the threshold."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for ka, wa, kb, wb in zip(*(batch[c] for c in ("keys_a", "weights_a", "keys_b", "weights_b"))):
                a = np.frombuffer(ka, np.uint64), np.frombuffer(wa)
                b = np.frombuffer(kb, np.uint64), np.frombuffer(wb)
                keep.append(similarity(a, b) >= THRESHOLD - 1e-9)
            yield batch.loc[keep, ["a", "b"]]

    for c in ("a", "b"):
        named = sets.withColumnsRenamed({"node": c, "keys": f"keys_{c}", "weights": f"weights_{c}"})
        pairs = pairs.join(named, c)
    return written(pairs.mapInPandas(run, _PAIR), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``row, doc_id, node, class_id, kept`` of every row of documents.

    ``docs`` has doc_id and text; other columns are not read. ``class_id`` is the lowest
    doc_id of the row's class.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    idf = spark.sparkContext.broadcast(idf_table(docs))
    rows = written(
        _signatures(docs, idf).withColumn("row", F.monotonically_increasing_id()), "signatures"
    )
    key = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"))
    nodes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.first("bands").alias("bands"), F.first("samples").alias("samples"), F.min(key).alias("key")
    )
    nodes = written(nodes, "nodes")
    keys = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Only texts that share a bucket carry their samples there.
    members = keys.join(sizes, "bucket").join(nodes.select("node", "samples", "key"), "node")
    members = written(members, "members")
    sets = _shingle_sets(
        with_key(docs, "text"),
        with_key(members.select("node", "key.*").distinct().withColumnRenamed("id", "doc_id"), "node"),
        idf,
    )

    def block_of(size: int) -> Column:
        return F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("n") / size)).cast("int")

    blocks = members.select("bucket", "node", "samples", block_of(BLOCK).alias("block"))
    star = blocks.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "node")
    star = star.mapInPandas(_best_before, _PAIR)
    # The blocks of a divided bucket are tied together by their first texts.
    heads = (
        members.where(F.col("n") > BLOCK)
        .groupBy("bucket", block_of(BLOCK).alias("block"))
        .agg(F.min("node").alias("a"))
    )
    heads = heads.join(heads.groupBy("bucket").agg(F.min("a").alias("b")), "bucket")
    pairs = star.unionByName(heads.where("a != b").select("a", "b")).distinct()
    links = _verified(pairs, sets)
    parts = components(links)

    placed = members.join(parts, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    several = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    several = several.where("low != high").select("bucket")
    mixed = placed.join(several, "bucket").join(sets, "node")
    mixed = mixed.withColumns({"side": block_of(SET_BLOCK), "blocks": F.ceil(F.col("n") / SET_BLOCK)})
    # Each text goes to one task for every block of its bucket, its own included.
    meeting = mixed.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    by = ["bucket", "block", "other"]
    meeting = meeting.select(
        "bucket", "band", "node", "samples", "component", "side", "keys", "weights",
        F.least("side", "_k").alias("block"), F.greatest("side", "_k").alias("other"),
    )
    more = meeting.repartition(*by).sortWithinPartitions(*by).mapInPandas(_links_across, _PAIR)
    more = written(more.distinct(), "more_links")
    # Nothing below reads texts; workers need the table no more.
    idf.unpersist()
    if more.limit(1).count():
        parts = components(links.unionByName(more))

    found = rows.select("row", "doc_id", "node").join(parts, "node", "left")
    found = written(found.withColumn("class", F.coalesce("component", "node")), "classes")
    own = found.where("class is not null")
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row"))
    firsts = own.groupBy("class").agg(first_row.alias("first"))
    linked = own.join(firsts, "class").select(
        "row", "doc_id", "node",
        F.col("first.doc_id").alias("class_id"),
        (F.col("row") == F.col("first.row")).alias("kept"),
    )
    alone = found.where("class is null").select(
        "row", "doc_id", "node", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept")
    )
    return linked.unionByName(alone)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents without all but one row of each class; all columns stay."""
    decided = written(with_key(near_duplicates(docs), "node", "kept"), "decided")
    kept = decided.where("kept")
    # The columns travel in a struct, so that no name can clash.
    keyed = with_key(docs, F.col("text").alias("text"), F.struct(*docs.columns).alias("rest"))
    key = ["absent", "id"]
    if not decided.groupBy(*key).count().where("count > 1").limit(1).count():
        # Ids are unique, so they tell which rows stay.
        ids = kept.select(*key)
        small = ids.count() * 32 <= BROADCAST_BYTES
        return keyed.join(F.broadcast(ids) if small else ids, key, "left_semi").select("rest.*")

    keyed = keyed.withColumn("node", _node_of("text"))
    alone = keyed.where("node is null").select("rest.*")
    key.append("node")
    ours = keyed.where("node is not null").join(kept.where("node is not null").select(*key), key)
    # Rows of equal id and words are the only ones left to choose from.
    again = written(ours.groupBy(*key).count().where("count > 1").drop("count"), "repeated")
    if again.limit(1).count():
        # Map-side, so that a row repeated very often meets its copies one per task.
        more = ours.join(again, key, "left_semi").groupBy(*key).agg(F.min_by("rest", "text").alias("rest"))
        ours = ours.join(again, key, "left_anti").select("rest").unionByName(more.select("rest"))
    return ours.select("rest.*").unionByName(alone)
