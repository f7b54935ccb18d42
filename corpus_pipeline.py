"""A cleaning pipeline over documents, one stage per operator.

Every stage reads what the one before it wrote, whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenlink.llm import fertility, line_crf, packing, suffix_dedup, weighted_minhash
from nomenlink.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the conditional random field finds good.

    Null and wordless texts score 0 and go; repeated rows share one fate. Without labels of
    both classes all documents stay.
    """
    model = line_crf.train(docs, table(spark, sf_dir, "labels"))
    return line_crf.filter_documents(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the base rules and the bands of tokeniser fertility.

    Null and short texts fail the base rules and go; repeated rows share one fate.
    """
    return fertility.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of repeated rows one.

    Null and wordless texts are no copies of each other and stay.
    """
    return weighted_minhash.deduplicate(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of passages; the first copy stays.

    A document stays even if nothing of its text is left, and of rows of equal id and text
    all but one are emptied. ``n_chars`` follows the text where there is such a column, and
    stays null with a null text.
    """
    cleaned = suffix_dedup.remove_repeats(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in few sequences; a null text is packed as an empty one."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("best-fit packing", best_fit_packing),
]

# The classifier, the samplings and the packing search have no SQL form. Tests hold the
# deduplications and the packing against brute force, and the two filters against their own
# operators, whose parts are tested against plain forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
