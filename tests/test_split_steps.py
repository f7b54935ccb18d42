from nomenlink import split_known_unknown

COLUMNS = """id long, sci_clean string, comm_clean string, code long, code_svc string, code_type string,
code_definitive boolean, code_src string, sugg_spelling string"""


def test_the_split_derives_its_candidates_once(spark):
    rows = [
        (1, None, None, 10, "A", "TSN", True, "common", None),
        (1, None, None, 11, "A", "TSN", False, "common", None),
        (2, None, None, 12, "A", "TSN", True, "common", None),
        (2, None, None, 13, "B", "TSN", False, "common", None),
        (None, None, None, 14, "B", "TSN", True, "common", None),
    ]
    cands = spark.createDataFrame(rows, COLUMNS)
    master = spark.createDataFrame([(1, "SCI", "COMM")], "id long, sci_clean string, comm_clean string")
    known, unknown = split_known_unknown(cands, master)
    assert [(r["id"], r["sci_clean"], r["code"]) for r in known.collect()] == [(1, "SCI", 10)]
    assert [(r["id"], r["sci_clean"], r["code"]) for r in unknown.collect()] == [(2, None, 13)]
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert unknown._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
