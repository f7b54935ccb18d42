"""Runs that end early and are started again."""

import uuid

import pytest

from nomenlink import resolve_names, resolve_resumably
from nomenlink.sources import runs
from nomenlink.sources.staging import shared_dir

from test_policies import snapshots
from test_resolve import NAMES, as_sets, random_world

COLUMNS = {"sci_col": "sci", "comm_col": "comm"}


class Stopped(Exception):
    pass


def exists(spark, folder):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


@pytest.mark.parametrize("after, limit", [(1, 1 << 20), (4, 0)])
def test_a_run_goes_on_after_its_last_whole_step(spark, monkeypatch, after, limit):
    world, rows = random_world(31)
    names, known = spark.createDataFrame(rows, NAMES), snapshots(spark, **world)
    folder = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    options = {**COLUMNS, "broadcast_bytes": limit}
    finish = runs.Run.finish

    def stopping(self, step, *more):
        # The step is written but its line is not, so it does not count.
        if step.number == after:
            raise Stopped
        finish(self, step, *more)

    monkeypatch.setattr(runs.Run, "finish", stopping)
    with pytest.raises(Stopped):
        resolve_resumably(names, known, folder, **options)
    assert runs.current_run() is None
    monkeypatch.setattr(runs.Run, "finish", finish)

    # Rows in another order and other partitions are the same input.
    result, run = resolve_resumably(names.repartition(3), known, folder, **options)
    assert len(run.reused) == after and len(run.made) > 0
    want = as_sets(resolve_names(names, known, **options))
    assert as_sets(result) == want

    result, again = resolve_resumably(names, known, folder, **options)
    assert again.made == [] and again.reused == run.reused + run.made
    assert as_sets(result) == want

    assert exists(spark, run.folder)
    again.remove()
    assert not exists(spark, run.folder) and exists(spark, folder)


def test_other_inputs_or_options_are_another_run(spark):
    frame = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, None, "b")], NAMES)
    folder = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"

    def key(names, **options):
        return runs.Run(spark, folder, {"names": names}, options).key

    first = key(frame, debug=True)
    assert key(frame.repartition(2), debug=True) == first
    swapped = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, "b", None)], NAMES)
    others = [
        key(frame, debug=False), key(frame.distinct(), debug=True), key(swapped, debug=True),
        key(frame.limit(0), debug=True), key(frame.withColumnRenamed("sci", "x"), debug=True),
    ]
    assert len({first, *others}) == 6


def test_a_step_that_is_not_the_one_expected_is_an_error(spark):
    from nomenlink.sources.staging import written

    frame = spark.range(3)
    run = runs.Run(spark, f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}", {"in": frame}, {})
    with run.steps():
        written(frame, "one")
    with run.steps(), pytest.raises(RuntimeError, match="step 0"):
        written(frame, "two")
    with run.steps():
        assert written(spark.range(9).select("id"), "one").count() == 3
