import pytest
from pyspark.sql import functions as F

from nomenlink import (
    assemble,
    combine_services,
    flag_ambiguous,
    prefer_exact_spelling,
    review_spelling,
    select_candidates,
    split_known_unknown,
    unchecked_codes,
    with_row_id,
)
from nomenlink.operators.candidates import CANDIDATE_SCHEMA


def candidates(spark, *rows):
    """Rows of id, code, service, type, definitive, source, spelling; names are fixed."""
    full = [(r[0], "SCI", "COMM", *r[1:]) for r in rows]
    return spark.createDataFrame(full, CANDIDATE_SCHEMA)


def values(df, *columns):
    found = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(found, key=lambda row: [(v is None, v) for v in row])


def test_equal_codes_of_several_services_combine(spark):
    got = combine_services(
        candidates(
            spark,
            (1, 5, "WORRMS", "TSN", False, "common", None),
            (1, 5, "RITIS", "TSN", False, "common", None),
            (1, 5, "RITIS", "TSN", False, "common", None),
            (1, 5, "RITIS", "TSN", False, "common", "X"),
            (1, None, "RITIS", "TSN", None, None, None),
            (2, 5, None, "TSN", False, "common", None),
        )
    )
    assert values(got, "id", "code", "code_svc", "sugg_spelling") == [
        (1, 5, "RITIS", "X"), (1, 5, "RITIS,WORRMS", None), (1, None, "RITIS", None),
        (2, 5, None, None),
    ]


def test_unknown_rows_of_known_ids_go(spark):
    cands = candidates(
        spark,
        (1, 5, "WORRMS", "APHIAID", True, "common", None),
        (1, 6, "WORRMS", "APHIAID", False, "common", None),
        (1, 7, "RITIS", "TSN", False, "common", None),
        (2, 8, "RITIS", "TSN", None, "common", None),
        (3, 9, "RITIS", None, True, "common", None),
        (3, 10, "RITIS", None, False, "common", None),
    )
    known, unknown = split_known_unknown(cands)
    assert values(known, "id", "code") == [(1, 5), (3, 9)]
    assert values(unknown, "id", "code") == [(1, 7), (2, 8)]
    master = spark.createDataFrame([(1, "A", "B")], "id long, sci_clean string, comm_clean string")
    known, unknown = split_known_unknown(cands, master)
    assert values(known, "id", "code", "sci_clean") == [(1, 5, "A")]
    # Unknowns of an id that the master lacks stay, without names.
    lacking = [r for r in unknown.collect() if r["id"] != 1]
    assert lacking and all(r["sci_clean"] is None and r["comm_clean"] is None for r in lacking)
    assert [r["code"] for r in unknown.collect() if r["id"] == 1] == [7]


@pytest.mark.parametrize(
    "sugg, want",
    [
        ("SCI", None), ("COMM", None), ("SCI (SCIENTIFIC)", None), ("(COMMON) COMM", None),
        ("SCI (COMMON)", "SCI (COMMON)"), ("OTHER", "OTHER"), (None, None), ("sci", "sci"),
    ],
)
def test_suggestions_that_repeat_the_name_are_nulled(spark, sugg, want):
    got = review_spelling(candidates(spark, (1, 5, "S", "TSN", False, "common", sugg)))
    assert got.first()["sugg_spelling"] == want


def test_a_missing_name_does_not_null_a_suggestion(spark):
    row = candidates(spark, (1, 5, "S", "TSN", False, "common", "X"))
    row = row.withColumn("sci_clean", F.lit(None).cast("string"))
    assert review_spelling(row).first()["sugg_spelling"] == "X"


def test_exact_spellings_are_preferred_among_undecided(spark):
    got = prefer_exact_spelling(
        candidates(
            spark,
            (1, 5, "S", "TSN", False, "common", None),
            (1, 6, "S", "TSN", False, "common", "X"),
            (1, 7, "S", "APHIAID", False, "common", "X"),
            (1, 8, "S", "APHIAID", False, "common", "Y"),
            (2, 9, "S", "TSN", True, "common", "X"),
            (2, 10, "S", "TSN", True, "common", None),
        )
    )
    assert values(got, "id", "code") == [(1, 5), (1, 7), (1, 8), (2, 9), (2, 10)]


def test_rank_selection(spark):
    rows = [
        # First definitive rank wins, with its definitive rows only.
        (1, 5, False, 1), (1, 6, True, 2), (1, 7, True, 2), (1, 8, False, 2), (1, 9, True, 4),
        # Else the last rank that gave a code.
        (2, 5, False, 1), (2, 6, False, 2), (2, 7, None, 2), (2, None, False, 5),
        # Nothing but a null code.
        (3, None, False, 1),
    ]
    cands = spark.createDataFrame(
        [(i, "TSN", c, d, r) for i, c, d, r in rows],
        "id long, code_type string, code long, code_definitive boolean, rank int",
    )
    assert values(select_candidates(cands, ["id"]), "id", "code") == [(1, 6), (1, 7), (2, 6), (2, 7)]


def test_checked_codes_are_left_out_per_type(spark):
    codes = spark.createDataFrame([("TSN", 1), ("TSN", 2), ("APHIAID", 1)], "code_type string, code long")
    checked = spark.createDataFrame([("TSN", 1)], "code_type string, code long")
    assert values(unchecked_codes(codes, checked), "code_type", "code") == [("APHIAID", 1), ("TSN", 2)]
    assert unchecked_codes(codes, None) is codes


def test_assembly_by_id(spark):
    cands = candidates(
        spark,
        (1, 5, "WORRMS", "APHIAID", True, "common", "X"),
        (1, 7, "RITIS", "TSN", False, "scientific", None),
        (1, 8, "RITIS", "TSN", False, "scientific", None),
        (2, 9, "RITIS", "TSN", True, "scientific", None),
    )
    flagged = flag_ambiguous(cands)
    assert values(flagged, "id", "code", "is_ambiguous") == [
        (1, 5, False), (1, 7, True), (1, 8, True), (2, 9, False)
    ]
    inputs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, label string")
    wide, report, _ = assemble(inputs, cands, debug=True)
    assert "id" not in wide.columns
    assert values(
        wide, "label", "aphiaid", "aphiaid_svc", "aphiaid_definitive", "aphiaid_src",
        "aphiaid_spelling", "tsn", "tsn_definitive", "aphiaid_multi_flag", "tsn_multi_flag",
    ) == [
        ("a", 5, "WORRMS", True, "common", "X", None, None, False, True),
        ("b", None, None, None, None, None, 9, True, False, False),
        ("c", None, None, None, None, None, None, None, False, False),
    ]
    assert values(report, "label", "code_sugg", "code_type") == [("a", 7, "TSN"), ("a", 8, "TSN")]
    assert wide.first()["id_src"].endswith("(DEBUG)")


def test_result_columns_must_be_free(spark):
    rows = spark.createDataFrame([(1, "a")], "id long, TSN string")
    with pytest.raises(ValueError, match="TSN"):
        assemble(rows, candidates(spark))


def test_row_ids_are_dense(spark):
    rows = spark.range(1000, numPartitions=7).select((999 - F.col("id")).alias("k"))
    ordered = with_row_id(rows, ["k"])
    assert values(ordered, "id", "k") == [(i + 1, i) for i in range(1000)]
    as_they_lie = with_row_id(rows, output="n")
    assert values(as_they_lie, "n", "k") == [(i + 1, 999 - i) for i in range(1000)]
    with pytest.raises(ValueError, match="already"):
        with_row_id(rows, output="k")
    assert with_row_id(rows.where("k < 0")).count() == 0
