"""Every stage of the pipeline against a brute-force version of it, on its own input."""

import os

import pytest

import corpus_pipeline
from nomenlink.llm import fertility, line_crf
from nomenlink.llm.weighted_minhash import idf_table

from .test_packing import check_whole
from .test_suffix_dedup import covered
from .test_weighted_minhash import classes

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.fixture(scope="module")
def steps(spark):
    """The input of each stage, and the last result."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), name.replace(" ", "_"))
        out.append(docs)
    return out


def test_stages_keep_the_columns(steps):
    assert all(x.schema.names == steps[0].schema.names for x in steps[1:-1])


def test_quality_classifier(spark, steps):
    model = line_crf.train(steps[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rows = rows_of(steps[0])
    good = line_crf.scores(model, [r[1] for r in rows]) >= line_crf.THRESHOLD
    assert rows_of(steps[1]) == [r for r, keep in zip(rows, good) if keep]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r[0] for r in rows_of(steps[1])}
    assert all((labels[i] == 1) == (i in kept) for i in labels)


def test_quality_rules(steps):
    kept = {r.doc_id for r in fertility.judge(steps[1]).collect() if r.kept}
    assert rows_of(steps[2]) == [r for r in rows_of(steps[1]) if r[0] in kept]
    plain = [r for r in rows_of(steps[1]) if fertility.measure_text(r[1])["n_words"] >= 50]
    assert len(plain) - len(kept) < 0.05 * len(plain)


def test_near_dedup(steps):
    rows = rows_of(steps[2])
    found = classes([r[:2] for r in rows], idf_table(steps[2]))
    assert rows_of(steps[3]) == [r for r, first in zip(rows, found) if r[0] == first]


def test_passage_dedup(steps):
    rows = rows_of(steps[3])
    expected = []
    for r, flags in zip(rows, covered([r[:2] for r in rows], 200, True)):
        text, at = "", 0
        for c in r[1]:
            size = len(c.encode())
            text += "" if all(flags[at : at + size]) else c
            at += size
        expected.append((r[0], text, *r[2:-1], len(text)))
    assert rows_of(steps[4]) == expected


def test_packing(steps):
    check_whole([r[:2] for r in rows_of(steps[4])], steps[5].collect(), 2048)


def test_registered(spark, steps):
    import __spark_entry__ as entry_points

    assert "pipeline" in entry_points.queries() and "pipeline" not in entry_points.oracle_sql()
    again = entry_points.queries()["pipeline"](spark, FOLDER)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows_of(again.select(*columns)) == rows_of(steps[5].select(*columns))
