"""Token counts of sections or fields by offset-mapped attribution.

A document is encoded once and whole, so its tokens are those that a model would see. The
byte spans of the tokens, which tile the text, are joined with the spans of its sections,
which tile it too. A token inside one section counts there. A token that crosses a
boundary is allocated by an explicit rule:

* ``most``: to the section with most of its bytes, the first of equals;
* ``first``: to the section with its first byte;
* ``last``: to the section with its last byte.

So the counts of a document's sections always add up to its tokens.

Defined results: a null text has no sections and gives no row; an empty text is one empty
section without tokens. Sections may be empty only at the end of a text. Repeated rows
and ids give rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_id, remembered, small_batches, tidy, with_key
from .vocabularies import byte_bpe, byte_ranks, encode_ids

RULES = ("most", "first", "last")


@remembered
def token_lengths(folder: str | None = None) -> np.ndarray:
    """Number of bytes of each token id."""
    ranks = byte_ranks(folder)
    size = byte_bpe(folder).get_vocab_size(with_added_tokens=True)
    out = np.zeros(size, np.int64)
    for i in range(size):
        try:
            out[i] = len(ranks.decode_single_token_bytes(i))
        except KeyError:
            out[i] = len(byte_bpe(folder).id_to_token(i).encode())
    return out


def line_starts(text: str) -> list[int]:
    """Sections are lines; a line ends with its line feed."""
    starts = [0]
    at = text.find("\n")
    while 0 <= at < len(text) - 1:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def paragraph_starts(text: str) -> list[int]:
    """Sections are paragraphs; a paragraph ends with the empty lines after it."""
    starts = [0]
    at = text.find("\n\n")
    while at >= 0:
        while at < len(text) and text[at] == "\n":
            at += 1
        if at < len(text):
            starts.append(at)
        at = text.find("\n\n", at)
    return starts


SECTIONS: dict[str, Callable[[str], list[int]]] = {
    "lines": line_starts,
    "paragraphs": paragraph_starts,
}


def allocate(lengths: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For each token its section, and whether it crosses a boundary.

    ``lengths`` are the bytes of the tokens in order, ``starts`` the ascending byte starts
    of the sections, the first of them 0.
    """
    ends = np.cumsum(lengths)
    first = np.searchsorted(starts, ends - lengths, side="right") - 1
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    crossing = first != last
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    out = first.copy()
    for i in np.flatnonzero(crossing).tolist():
        inner = starts[first[i] + 1 : last[i] + 1]
        parts = np.diff(np.concatenate([[ends[i] - lengths[i]], inner, [ends[i]]]))
        out[i] = first[i] + int(parts.argmax())
    return out, crossing


def section_counts(
    text: str, ids: np.ndarray, starts: list[int], rule: str, folder: str | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per section: end in characters, tokens allocated, crossing tokens among them."""
    chars = np.array(starts, np.int64)
    if text.isascii():
        bytes_ = chars
    else:
        # Bytes before each character.
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        bytes_ = np.concatenate([[0], np.cumsum(sizes)])[chars]
    section, crossing = allocate(token_lengths(folder)[ids], bytes_, rule)
    n = len(starts)
    ends = np.append(chars[1:], len(text))
    return ends, np.bincount(section, minlength=n), np.bincount(section[crossing], minlength=n)


def count_by_section(
    docs: DataFrame, sections: str = "lines", rule: str = "most", folder: str | None = None
) -> DataFrame:
    """``doc_id, section, start, end, n_tokens, n_crossing`` of every section.

    ``section`` counts from 0; ``start`` and ``end`` are characters of the text.
    ``n_crossing`` are the tokens allocated here that other sections share. ``docs`` has
    doc_id and text.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    starts_of = SECTIONS[sections]
    small_batches(docs.sparkSession)
    keyed = with_key(docs, "text").where("text is not null")

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, out = [], []
            texts = batch["text"].tolist()
            for row, (text, ids) in enumerate(zip(texts, encode_ids(texts, folder))):
                starts = starts_of(text)
                ends, tokens, crossing = section_counts(text, ids, starts, rule, folder)
                rows.append(np.full(len(starts), row))
                out.append((np.arange(len(starts)), np.array(starts), ends, tokens, crossing))
            if not rows:
                continue
            at = np.concatenate(rows)
            found = {c: np.concatenate(x) for c, x in zip(_SECTION, zip(*out))}
            yield pd.DataFrame(
                {"absent": batch["absent"].to_numpy()[at], "id": batch["id"].to_numpy()[at], **found}
            )

    kind = dict(keyed.dtypes)["id"]
    schema = f"absent boolean, id {kind}, " + ", ".join(f"{c} long" for c in _SECTION)
    return keyed.mapInPandas(run, schema).select(doc_id(), *_SECTION)


_SECTION = ["section", "start", "end", "n_tokens", "n_crossing"]


def count_by_field(
    docs: DataFrame,
    fields: tuple[str, ...],
    separator: str = "\n",
    rule: str = "most",
    folder: str | None = None,
) -> DataFrame:
    """``doc_id`` and a struct ``n_tokens`` with a count per field.

    The fields are joined by the separator, which belongs to the field before it, and
    encoded as one text. A null field is empty. Without separator a field may be empty;
    then tokens count for the next field that is not.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<long>")
    @tidy
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            out = []
            for values in zip(*columns):
                parts = [v or "" for v in values]
                parts = [p + separator for p in parts[:-1]] + parts[-1:]
                text = "".join(parts)
                starts = np.cumsum([0] + [len(p) for p in parts[:-1]]).tolist()
                ids = encode_ids([text], folder)[0]
                out.append(section_counts(text, ids, starts, rule, folder)[1])
            yield pd.Series(out)

    counts = run(*(F.col(f).cast("string") for f in fields))
    found = docs.select("doc_id", counts.alias("_counts"))
    by_field = F.struct(*(F.col("_counts")[i].alias(f) for i, f in enumerate(fields)))
    return found.select("doc_id", by_field.alias("n_tokens"))
