"""Fixed values of the name-cleaning rules.

Every word and pattern below decides results, so they are plain data, in the order
in which they apply. Patterns are Java regular expressions over upper-cased text;
``(?s)`` lets ``.`` cross line ends and ``\\z`` is the very end of the text.
"""

from __future__ import annotations

# --- fixed values: rank words, removed wherever they stand as whole words ---
RANK_WORDS = (
    "DOMAIN", "KINGDOM", "PHYLUM", "DIVISION", "SUBPHYLUM", "SUBDIVISION", "CLASS",
    "SUBCLASS", "SUPERORDER", "ORDER", "SUBORDER", "FAMILY", "SUBFAMILY", "GENUS",
    "SPECIES",
)

# --- fixed values: patterns removed from both kinds of name, after the rank words ---
SHARED_REMOVALS = (
    r"(\(NS\)|\bNS)",
    r"(?s)(-|,|\s)?UNIDENTIFIED.*",
    r"(\)|^|-|,|\s)?UNID(EN)?(T?)\.*",
    r"([^']\b[SP]{1,3}\.?\z)",
    r"\b[a-zA-Z]{1,2}\.",
)

# --- fixed values: patterns removed from one kind of name only, last ---
SCIENTIFIC_REMOVALS = (r"\bOBSOLETE\b", r"(?s)\(.*?\)")
COMMON_REMOVALS = (r"\(", r"\)")

# --- fixed values: text without which a pattern cannot match, where there is one ---
TRIGGERS = {
    r"(\(NS\)|\bNS)": "NS",
    r"(?s)(-|,|\s)?UNIDENTIFIED.*": "UNIDENTIFIED",
    r"(\)|^|-|,|\s)?UNID(EN)?(T?)\.*": "UNID",
    r"\b[a-zA-Z]{1,2}\.": ".",
    r"\bOBSOLETE\b": "OBSOLETE",
    r"(?s)\(.*?\)": "(",
    r"\(": "(",
    r"\)": ")",
}

# --- fixed values: whole words or phrases that make the field useless ---
SHARED_DROP_WORDS = (
    "BAIT", "DIGESTED", "NIDENTIFIED PER", "UNIDENTIFIED SPECIES",
    "UNID (?:FISH|REMAINS)+", "REMAINS", "SURVEY", "FSRS -", "RESERVED", "PURSE",
    "INVERTEBRATE", "EGGS?", "INORGANIC DEBRIS", "MIXED", "MUCUS", "OPERCULUM",
    "FLUID", "LARVAE", "AND",
)
SCIENTIFIC_DROP_WORDS = (
    "WHALE", "CRAB", "LOBSTER", "SHRIMP", "IRISH MOSS", "SHARK", "COD WORM", "CORALS",
    "SKATE", "FINFISHES", "GROUNDFISH", "PELAGIC FISH", "SAND TUBE",
)

# --- fixed values: texts that make the field useless anywhere, or as the whole field ---
DROP_ANYWHERE = ("ETC",)
DROP_WHOLE_FIELD = ("FISH", "WATER", "SHARK", "SAND")

# --- fixed values: markers ignored when a suggestion is compared with the name sent ---
SCIENTIFIC_MARKER = r"\(SCIENTIFIC\)"
COMMON_MARKER = r"\(COMMON\)"

# --- fixed values: shortest usable name, and the characters trimmed from its ends ---
MIN_LENGTH = 4
TRIMMED = " \t\r\n"

KINDS = ("scientific", "common")


def whole_words(words: tuple[str, ...]) -> str:
    """One pattern for any of the words, bounded once instead of once per word."""
    return r"\b(?:" + "|".join(words) + r")\b"


def removals(kind: str, extra: tuple[str, ...] = ()) -> tuple[str, ...]:
    """The removal patterns of a kind in order; the caller's go before the kind's own."""
    last = SCIENTIFIC_REMOVALS if kind == "scientific" else COMMON_REMOVALS
    return (whole_words(RANK_WORDS), *SHARED_REMOVALS, *extra, *last)


def drops(kind: str) -> str:
    """One pattern that is found in every field of this kind that must become null."""
    words = SHARED_DROP_WORDS
    if kind == "scientific":
        words = words + SCIENTIFIC_DROP_WORDS
    whole = "^(?:" + "|".join(DROP_WHOLE_FIELD) + r")\z"
    return "|".join((whole_words(words), *DROP_ANYWHERE, whole))
