"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    code_compression,
    cover_tree,
    fertility,
    lattice_sampling,
    line_crf,
    merkle_manifest,
    nearest_examples,
    oracles,
    packing,
    rank_profiles,
    suffix_dedup,
    token_attribution,
    url_markov,
    weighted_minhash,
)
from .common import table

RULES = (
    url_markov.Rule("allow", "com", "/"),
    url_markov.Rule("block", "example.com", "/en/"),
    url_markov.Rule("allow", "www.example.com", "/en/"),
    url_markov.Rule("block", "net", "/es/"),
    url_markov.Rule("block", "net", "/fr/"),
)

Query = Callable[[SparkSession, str], DataFrame]


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of cosine 0.95 and more."""
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or character model verdict of every page url."""
    judged = url_markov.judge(table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of tokeniser fertility bands."""
    return fertility.judge(table(spark, sf_dir, "documents"))


def op4_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, encoded whole."""
    return token_attribution.count_by_section(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in strings of 200 bytes that start anywhere else, removed."""
    return suffix_dedup.digest(table(spark, sf_dir, "documents"), keep_first=False)


def op6_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, and whether it is the one kept."""
    found = weighted_minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "kept")


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document quality from line marginals of a conditional random field."""
    return line_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by rank-order profiles of character n-grams."""
    return rank_profiles.classify(table(spark, sf_dir, "documents"))


def op9_lattice_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document, and whether it decodes to the text."""
    return lattice_sampling.digest(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in as few sequences as the search finds."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether a tampered copy verifies."""
    docs = table(spark, sf_dir, "documents")
    claim = {"text": merkle_manifest.tampered_text(F.col("doc_id"), F.col("text"))}
    return merkle_manifest.manifest(docs, claim)


def op12_nearest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document from its nearest labelled examples."""
    return nearest_examples.classify(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op13_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, errors and codebooks of all embeddings."""
    return code_compression.digest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_cover_tree,
        op2_url_markov,
        op3_fertility,
        op4_token_attribution,
        op5_suffix_dedup,
        op6_weighted_minhash,
        op7_line_crf,
        op8_rank_profiles,
        op9_lattice_sampling,
        op10_packing,
        op11_merkle_manifest,
        op12_nearest_examples,
        op13_code_compression,
    )
}

# The others have no SQL form; tests hold them against brute force or held-out labels.
ORACLES: dict[str, str] = {
    "op1_cover_tree": oracles.COVER_TREE,
    "op2_url_markov": url_markov.oracle(RULES),
    "op5_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op6_weighted_minhash": oracles.WEIGHTED_MINHASH,
    "op8_rank_profiles": oracles.RANK_PROFILES,
    "op11_merkle_manifest": oracles.MERKLE_MANIFEST,
    "op13_code_compression": oracles.CODE_COMPRESSION,
}
