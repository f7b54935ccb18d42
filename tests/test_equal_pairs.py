from nomenlink.plans import resolve
from test_policies import snapshots

ROWS = "id long, sci_clean string, comm_clean string"


def found(spark, rows):
    world = snapshots(
        spark,
        worms_taxa=[(7, "GADUS MORHUA", "accepted", 8, "GADUS"), (9, "SALMO SALAR", "accepted", 9, "SALMO SALAR")],
        itis_names=[(70, "GADUS MORHUA")],
    )
    return resolve.resolve_pairs(spark.createDataFrame(rows, ROWS), world).frame


def test_equal_pairs_are_decided_once(spark, monkeypatch):
    decided = []
    choose = resolve.choose
    monkeypatch.setattr(
        resolve, "choose", lambda pairs, *rest: decided.append(pairs.count()) or choose(pairs, *rest)
    )
    rows = [(i, "GADUS MORHUA", None) for i in range(40)] + [(50, "SALMO SALAR", "LAX"), (51, None, None)]
    got = {(r["id"], r["code_type"], r["code"]) for r in found(spark, rows).collect()}
    assert decided == [2]
    want = {(i, "APHIAID", 8) for i in range(40)} | {(i, "TSN", 70) for i in range(40)}
    assert got == want | {(50, "APHIAID", 9)}


def test_ids_that_are_repeated_or_null(spark):
    rows = [
        (1, "GADUS MORHUA", None), (1, "GADUS MORHUA", None), (2, "GADUS MORHUA", None),
        (2, "SALMO SALAR", None), (None, "SALMO SALAR", None),
    ]
    got = sorted(
        (r["id"] or 0, r["code_type"], r["code"]) for r in found(spark, rows).collect()
    )
    assert got == [
        (0, "APHIAID", 9), (1, "APHIAID", 8), (1, "TSN", 70),
        (2, "APHIAID", 8), (2, "APHIAID", 9), (2, "TSN", 70),
    ]
