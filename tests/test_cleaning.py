import random
import re

import pytest
from pyspark.sql import functions as F

from nomenlink import clean_names, strip_redundant
from nomenlink.functions import rules
from nomenlink.functions.cleaning import invert_comma

# raw scientific, cleaned, raw common, cleaned
GOLDEN = [
    ("OSMERUS MORDAX", "OSMERUS MORDAX", "SMELT", "SMELT"),
    ("SELACHII (CHONDRICHTHYES) (CLASS)", "SELACHII", "CARTILAGINOUS FISHES", "CARTILAGINOUS FISHES"),
    ("LIPARIS  SP.", "LIPARIS", "SEASNAILS (NS) LIP.SP.", "SEASNAILS LIP"),
    ("OSTRACIONTIDAE (OSTRACIIDAE)", "OSTRACIONTIDAE", "TRUNKFISHES (NS)", "TRUNKFISHES"),
    ("PHYLLODOCE SP.", "PHYLLODOCE", "POLYCHAETE", "POLYCHAETE"),
    ("SPIO SP.", "SPIO", "POLYCHAETE", "POLYCHAETE"),
    ("DENTALIUM ENTALE", "DENTALIUM ENTALE", "TUSK SHELL", "TUSK SHELL"),
    ("GADUS SPP", "GADUS", "SHARK, GREENLAND", "GREENLAND SHARK"),
    ("UNIDENTIFIED SPECIES", None, "SKATE,SMOOTH, LARGE", "LARGE SKATE"),
    ("GADUS SPP.", "GADUS", "cod eggs", None),
    ("SHRIMP UNIDENT.", None, "KETCHUP FISH", None),
    ("BUCCINUM S.", "BUCCINUM", "FSRS - X", "FSRS - X"),
    ("ABC", None, "FSRS -X", None),
    ("AND", None, "SAND", None),
    ("ORDER DECAPODA", "DECAPODA", "HAKE, UNIDENTIFIED SMALL", "HAKE"),
    (None, None, None, None),
    ("FAMILY GADIDAE", "GADIDAE", "PETER'S P.", "PETER'S"),
    ("NSPIRA (OBSOLETE)", "PIRA", "FLOUNDER,", "FLOUNDER"),
    ("GADUS SPP UNIDENTIFIED", "GADUS", "UNID. FISH HEAD", "FISH HEAD"),
    ("", None, "   ", None),
    ("FISH\n", "FISH", "\tgreat  auk\r\n", "GREAT AUK"),
]


def clean(spark, values, kind, extra=()):
    rows = spark.createDataFrame(list(enumerate(values)), "id int, raw string")
    done = clean_names(rows, "raw", kind, extra, "x").orderBy("id").collect()
    return [r["x"] for r in done]


@pytest.mark.parametrize("kind, raw, want", [("scientific", 0, 1), ("common", 2, 3)])
def test_golden_names(spark, kind, raw, want):
    assert clean(spark, [g[raw] for g in GOLDEN], kind) == [g[want] for g in GOLDEN]


def test_cleaning_is_not_idempotent(spark):
    once = clean(spark, ["GADUS SPP (X) ORDER"], "scientific")
    assert once == ["GADUS SPP"]
    assert clean(spark, once, "scientific") == ["GADUS"]


def test_drop_rules_run_before_removals(spark):
    # A bare FISH is useless, but one that only remains after a removal is kept.
    assert clean(spark, ["FISH", "UNID. FISH"], "common") == [None, "FISH"]


def test_etc_has_no_word_boundary(spark):
    assert clean(spark, ["SKETCH CRAB", "CRABS, ETC."], "common") == [None, None]


def test_scientific_field_is_dropped_for_common_words(spark):
    names = ["BLUE WHALE", "IRISH MOSS X", "WHALEBONE", "SKATES"]
    assert clean(spark, names, "scientific") == [None, None, "WHALEBONE", "SKATES"]
    assert clean(spark, names, "common") == names[:1] + ["IRISH MOSS X"] + names[2:]


def test_caller_filters_are_case_sensitive_on_upper_cased_text(spark):
    assert clean(spark, ["red cod fish"], "common", ["RED"]) == ["COD FISH"]
    assert clean(spark, ["red cod fish"], "common", ["red"]) == ["RED COD FISH"]
    assert clean(spark, ["red cod fish"], "common", ["(?i)red"]) == ["COD FISH"]


def test_caller_filters_run_after_the_shared_and_before_the_own_rules(spark):
    # The rank word is gone before the filter sees the text, the bracket is not.
    assert clean(spark, ["GADUSUS CLASS"], "scientific", ["CLASS|US$"]) == ["GADUS"]
    assert clean(spark, ["GADUS (MORHUA) X"], "scientific", [r"\) X$"]) == ["GADUS (MORHUA"]


def test_groups_of_several_caller_filters_keep_their_numbers(spark):
    got = clean(spark, ["AA BB COD LIVER"], "common", [r"(A)\1 ", r"(B)\1 "])
    assert got == ["COD LIVER"]


def test_bad_filters_fail_at_the_call(spark):
    rows = spark.createDataFrame([("x",)], "raw string")
    with pytest.raises(ValueError, match="not a valid pattern"):
        clean_names(rows, "raw", "common", ["("])
    with pytest.raises(ValueError, match="sequence"):
        clean_names(rows, "raw", "common", "abc")
    with pytest.raises(ValueError, match="kind"):
        clean_names(rows, "raw", "latin")


def test_unicode_case(spark):
    assert clean(spark, ["straße cod", "raie étoilée"], "common") == ["STRASSE COD", "RAIE ÉTOILÉE"]


@pytest.mark.parametrize(
    "sci, comm, want",
    [
        ("A (B)", "A (B) FISH", " FISH"),
        ("X (", "X ( COD", " COD"),
        (None, "COD", "COD"),
        ("COD", None, None),
        ("", "COD", "COD"),
        ("cod", "COD cod", "COD "),
        (".", "COD.X.", "CODX"),
    ],
)
def test_strip_redundant_is_literal(spark, sci, comm, want):
    row = spark.createDataFrame([(sci, comm)], "sci string, comm string")
    assert strip_redundant(row, "sci", "comm").first()["comm"] == want


def test_invert_comma(spark):
    texts = ["A,B", "A, B", "A,B,C", ",A", "A,", ",", "AB", "A,\nB"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(invert_comma(F.col("t"))).collect()]
    assert got == ["B A", "B A", "C A", "A", "A", "", "AB", "B A"]


# --- the merged rules against every rule on its own, in plain Python ---

# --- fixed values: rank words, removal patterns, and words that make a field useless ---
_RANKS = (
    "DOMAIN KINGDOM PHYLUM DIVISION SUBPHYLUM SUBDIVISION CLASS SUBCLASS SUPERORDER ORDER "
    "SUBORDER FAMILY SUBFAMILY GENUS SPECIES"
).split()
_ONE_BY_ONE = [
    *(rf"\b{w}\b" for w in _RANKS), r"(\(NS\)|\bNS)", r"(-|,|\s)?UNIDENTIFIED.*",
    r"(\)|^|-|,|\s)?UNID(EN)?(T?)\.*", r"UNID\. FISH", r"([^']\b[SP]{1,3}\.?$)",
    r"\b[a-zA-Z]{1,2}\.",
]
_OWN = {
    "scientific": [r"\bOBSOLETE\b", r"\bUNIDENTIFIED\b", r"\(.*?\)"],
    "common": [r"\(", r"\)"],
}
_USELESS = [
    "BAIT", "DIGESTED", "NIDENTIFIED PER", "UNIDENTIFIED SPECIES", "UNID (FISH|REMAINS)+",
    "REMAINS", "SURVEY", "FSRS -", "RESERVED", "PURSE", "INVERTEBRATE", "EGG(S?)",
    "INORGANIC DEBRIS", "MIXED", "MUCUS", "OPERCULUM", "FLUID", "LARVAE", "AND",
]
_USELESS_SCIENTIFIC = [
    "WHALE", "CRAB", "LOBSTER", "SHRIMP", "IRISH MOSS", "SHARK", "COD WORM", "CORALS", "SKATE",
    "FINFISHES", "GROUNDFISH", "PELAGIC FISH", "SAND TUBE",
]


def useless(text, kind):
    words = _USELESS + (_USELESS_SCIENTIFIC if kind == "scientific" else [])
    if any(re.search(rf"\b{w}\b", text) for w in words):
        return True
    return "ETC" in text or text in ("FISH", "WATER", "SHARK", "SAND")


def naive(text, kind):
    if text is None:
        return None
    text = text.upper()
    if useless(text, kind):
        return None
    for rule in _ONE_BY_ONE + _OWN[kind]:
        text = re.sub(rule, "", text, flags=re.S)
        text = re.sub(" +", " ", text).strip(" \t\r\n")
    if kind == "common" and "," in text:
        parts = text.split(",")
        text = (parts[-1] + " " + parts[0]).strip(" \t\r\n")
    return text if len(text) >= 4 else None


@pytest.mark.parametrize("kind", rules.KINDS)
def test_merged_rules_equal_single_rules(spark, kind):
    pieces = [
        "GADUS", "SP.", "SPP", "P", "(NS)", "NS", "UNIDENTIFIED", "UNID.", "UNIDENT", "FISH",
        "ORDER", "SUBCLASS", "CLASS", "(", ")", ",", "-", "'", " ", "  ", "L.", "OBSOLETE",
        "EGGS", "AND", "\t", ".", "S", "MORHUA", "(X)", "\n", "UNID", "ETC", "SHARK",
    ]
    chance = random.Random(7)
    texts = [
        "".join(chance.choice(pieces) + chance.choice(["", " "]) for _ in range(chance.randint(1, 7)))
        for _ in range(4000)
    ]
    got = clean(spark, texts, kind)
    wrong = [(t, g, naive(t, kind)) for t, g in zip(texts, got) if g != naive(t, kind)]
    assert wrong == []
    assert sum(g is not None for g in got) > 1000


def test_a_filter_does_not_copy_the_chain(spark):
    rows = spark.createDataFrame([("GADUS",)], "raw string")
    done = clean_names(rows, "raw", "common", output="x").where(F.col("x").isNotNull())
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UNIDENTIFIED.*,") == 1
