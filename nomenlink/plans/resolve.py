"""The whole resolution: from a table of names to codes and ambiguous candidates.

Input rows take part only in the first aggregate, which leaves each distinct pair of
names once, and in the last join. Between them every distinct name is searched once,
every code crosses over once, and a pair gets only the candidates of its chosen search.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import eligible
from ..functions.rules import KINDS
from ..operators.assemble import (
    ANSWER,
    FLAG_COLUMNS,
    LISTED,
    REPORT_COLUMNS,
    WIDE_COLUMNS,
    Resolved,
    ambiguous_codes,
    answers,
    check_names_free,
    id_source,
    with_flags,
)
from ..operators.candidates import (
    prefer_exact_spelling,
    review_spelling,
    unchecked_codes,
)
from ..operators.groups import keep_if_any
from ..operators.joins import BROADCAST_BYTES, attach
from ..operators.lookups import (
    best_match,
    distinct_keys,
    search_itis_shortest,
    search_worms,
    verify_match,
    with_accepted,
    with_usage,
)
from ..operators.policies import (
    APHIAID,
    CODE_COLUMNS,
    TSN,
    aphia_links,
    decide_best,
    decide_itis,
    decide_worms,
    narrow_by_scientific,
    tsn_links,
)
from ..sources.authorities import Authorities
from ..sources.names import check_columns, distinct_names
from ..sources.staging import Staged, shuffled, stage, stage_unless_small, written
from .ranking import (
    BEST_RANK,
    ITIS_RANK,
    WORMS_RANK,
    name_facts,
    ranked_pairs,
    searches,
    spelling_facts,
    with_link_facts,
)


def resolve_names(
    names: DataFrame,
    authorities: Authorities,
    sci_col: str | None = None,
    comm_col: str | None = None,
    sci_filters: Sequence[str] = (),
    comm_filters: Sequence[str] = (),
    checked: DataFrame | None = None,
    debug: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    only: str | None = None,
    listed: int = LISTED,
) -> Resolved:
    """Find the AphiaID and the TSN of every row by its scientific and common name.

    The input is read twice: for its distinct names, and to meet their answers. What that
    gives is written, and both results are cut from it. Who needs ``only`` the result of
    that name, ``resolved`` or ``ambiguous``, gets its last join unwritten, and null for
    the other.

    ``checked`` may be the ``links`` of an earlier run: what the crosswalk answered then.
    Those codes are not looked up again, and the rows that have them get the old answers.
    """
    check_columns(names, sci_col, comm_col)
    check_names_free(names)
    if only not in (None, "resolved", "ambiguous"):
        raise ValueError(f"no such result: {only!r}")
    pairs = stage_pairs(names, sci_col, comm_col, sci_filters, comm_filters)
    cands, links = resolve_with_links(pairs.frame, authorities, checked, broadcast_bytes)

    result = put_together(
        names, pairs, cands, {"sci_raw": sci_col, "comm_raw": comm_col}, debug, broadcast_bytes, only, listed
    )
    return result._replace(links=links)


def put_together(
    names: DataFrame,
    pairs: Staged,
    cands: DataFrame,
    columns: dict[str, str | None],
    debug: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    only: str | None = None,
    listed: int = LISTED,
) -> Resolved:
    """Both results of the input rows from the candidates of their pairs, by the pair's ``id``.

    ``columns`` gives the input column of each raw name column of the pairs, if it has one.
    """
    keys = [(c, raw) for raw, c in columns.items() if c is not None]
    lookup_keys = [b for _, b in keys]
    ids = pairs.frame.select("id", *lookup_keys)

    def rows_per_pair() -> DataFrame:
        return pairs.frame.select(*lookup_keys, "n")

    cands = stage(cands, "candidates").frame
    found = answers(cands, listed)
    if only == "resolved":
        found = found.drop("report").withColumn("unlisted", F.lit(False))
    elif only == "ambiguous":
        found = found.where(F.col("unlisted") | F.col("report").isNotNull())
    packed = F.struct(*found.columns).alias(ANSWER)
    found = stage(ids.join(shuffled(found.select("id", packed)), "id").drop("id"), "answers")
    # The input meets its answers once, and both results are cut from what is written.
    how = "inner" if only == "ambiguous" else "left"
    both = attach(names, found, keys, how, rows_per_pair, broadcast_bytes)
    if only is None:
        both = written(both, "answered")

    stamp = id_source(debug).alias("id_src")
    inputs = [F.col(f"`{c}`") for c in names.columns]
    answer = F.col(ANSWER)
    codes = [answer[c].alias(c) for c in (*WIDE_COLUMNS, *FLAG_COLUMNS)]
    resolved = with_flags(both.select(*inputs, *codes))
    resolved = resolved.select(*inputs, *WIDE_COLUMNS, *FLAG_COLUMNS, stamp)
    if only == "resolved":
        return Resolved(resolved, None)
    ambiguous = both.select(*inputs, F.inline(answer["report"]))
    unlisted = found.frame.where(answer["unlisted"]).select(answer["id"].alias("id"))
    if unlisted.limit(1).count():
        entries = stage(ambiguous_codes(cands.join(unlisted, "id")), "unlisted")
        more = both.where(answer["unlisted"]).withColumn(ANSWER, answer["id"])
        per_id = lambda: more.groupBy(answer.alias("id")).agg(F.count(F.lit(1)).alias("n"))
        more = attach(more, entries, [(ANSWER, "id")], "inner", per_id, broadcast_bytes)
        ambiguous = ambiguous.unionByName(more.select(*ambiguous.columns))
    ambiguous = ambiguous.select(*inputs, *REPORT_COLUMNS, stamp)
    return Resolved(None if only else resolved, ambiguous)


def stage_pairs(
    names: DataFrame,
    sci_col: str | None,
    comm_col: str | None,
    sci_filters: Sequence[str] = (),
    comm_filters: Sequence[str] = (),
) -> Staged:
    """The distinct raw name pairs with their cleaned names, numbered and written.

    Writing them makes the generated ids stable.
    """
    pairs = distinct_names(names, sci_col, comm_col, sci_filters, comm_filters)
    return stage(pairs.withColumn("id", F.monotonically_increasing_id()), "pairs")


def resolve_pairs(
    pairs: DataFrame,
    authorities: Authorities,
    checked: DataFrame | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> Staged:
    """The chosen candidates of ``id, sci_clean, comm_clean`` rows, of both code types.

    ``pairs`` must be stable, as it is read more than once. Each distinct pair of names is
    resolved once, and its candidates are joined to the ids that have it. Rows whose id is
    null or has several pairs are resolved by id, as their candidates are one group.
    """
    keys = ("sci_clean", "comm_clean")
    pairs = pairs.where(eligible(*map(F.col, keys))).select("id", *keys)
    pair = F.struct(*keys)
    ids = pairs.groupBy("id").agg(F.min(pair).alias("pair"), F.max(pair).alias("other"))
    alone = F.col("id").isNotNull() & F.col("pair").eqNullSafe(F.col("other"))
    ids = written(ids.select("id", "pair.*", alone.alias("alone")), "ids")
    asked = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    asked = stage(asked.withColumn("id", F.monotonically_increasing_id()), "distinct_pairs").frame

    decided = stage(search_all(asked, authorities), "decided")
    links = stage(cross_all(decided.frame, authorities, checked), "links")
    per_pair = choose(asked.select("id", *keys), decided, links, broadcast_bytes)
    per_pair = stage(asked.select("id", *keys).join(shuffled(per_pair), "id").drop("id"), "pair_candidates")
    both = [(c, c) for c in keys]
    found = attach(
        ids.where("alone").select("id", *keys), per_pair, both, "inner",
        lambda: asked.select(*keys, "n"), broadcast_bytes,
    )
    found = found.select("id", *CODE_COLUMNS)
    others = ids.where(~F.col("alone")).select(F.col("id").alias("_id"))
    if others.limit(1).count():
        mine = pairs.join(shuffled(others), F.col("id").eqNullSafe(F.col("_id")), "left_semi")
        found = found.unionByName(choose(mine, decided, links, broadcast_bytes))
    return stage(found, "candidates")


def resolve_with_links(
    pairs: DataFrame,
    authorities: Authorities,
    checked: DataFrame | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """As ``resolve_pairs``, not written, and all crosswalk answers."""
    pairs = pairs.where(eligible(F.col("sci_clean"), F.col("comm_clean"))).select(
        "id", "sci_clean", "comm_clean"
    )
    decided = stage(search_all(pairs, authorities), "decided")
    links = stage(cross_all(decided.frame, authorities, checked), "links")
    return choose(pairs, decided, links, broadcast_bytes), links.frame


def choose(
    pairs: DataFrame, decided: Staged, links: Staged, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The candidates of the answering search of ``id, sci_clean, comm_clean`` rows.

    ``decided`` and ``links`` hold what the searches of all their names and the crosswalk of
    all their codes gave.
    """
    # One row of facts per name tells which search answers for a pair.
    linked = with_link_facts(decided.frame, links.frame)
    facts = stage_unless_small(name_facts(linked), "name_facts", decided, broadcast_bytes)
    spellings = stage_unless_small(
        spelling_facts(linked), "spelling_facts", decided, broadcast_bytes
    )
    known = pairs
    # No name of the facts is null, so a row without a name goes on without a match.
    for kind, key, prefix in zip(KINDS, ("sci_clean", "comm_clean"), ("sci", "comm")):
        mine = facts.where(F.col("kind") == kind)
        mine = mine.select(
            "name", *(F.col(c).alias(f"{prefix}_{c}") for c in ("best", "worms", "itis"))
        )
        known = attach(
            known, mine, [(key, "name")], "left", _counts(pairs, name=key), broadcast_bytes,
            null_keys=False,
        )
        if facts.size > broadcast_bytes:
            # A join split by hot keys reads its rows twice; cut before the next one.
            known = stage(known, f"{prefix}_known").frame
    both = [("comm_clean", "comm_clean"), ("sci_clean", "sci_clean")]
    known = attach(
        known, spellings, both, "left",
        _counts(pairs, comm_clean="comm_clean", sci_clean="sci_clean"), broadcast_bytes,
        null_keys=False,
    )
    chosen = stage(searches(ranked_pairs(known)), "chosen")

    # Only the chosen search of a pair is given to it.
    by_name = chosen.frame.where(F.col("name").isNotNull()).drop("sent")
    by_name = attach(
        by_name, decided, [(c, c) for c in ("name", "code_type", "rank")], "inner",
        _counts(by_name, name="name", code_type="code_type", rank="rank"), broadcast_bytes,
    )
    by_name = by_name.withColumn("several", F.coalesce("several", F.lit(False)))
    by_name = narrow_by_scientific(by_name)
    by_code = chosen.frame.where(F.col("sent").isNotNull())
    by_code = attach(
        by_code, links, [(c, c) for c in ("sent", "code_type")], "inner",
        _counts(by_code, sent="sent", code_type="code_type"), broadcast_bytes,
    )
    columns = ("id", "sci_clean", "comm_clean", *CODE_COLUMNS)
    found = by_name.select(*columns).unionByName(by_code.select(*columns))
    found = review_spelling(found.where(F.col("code").isNotNull()))
    if chosen.size > broadcast_bytes:
        # It is read three times below, which would repeat large joins.
        found = stage(found, "found").frame
    # A pair's candidates of one type come from one search, so they are all definitive
    # or all open, and share their service: only the open ones need a preference, and
    # equal ones need no more than removing.
    sure = F.col("code_definitive")
    exact = prefer_exact_spelling(found.where(~sure))
    result = found.where(sure).unionByName(exact).select("id", *CODE_COLUMNS)
    return result.distinct()


def search_all(pairs: DataFrame, authorities: Authorities) -> DataFrame:
    """The decided candidates of every distinct name, with the rank of their search.

    The names are written once, as every search reads them.
    """
    return search_names(stage(names_of(pairs), "names").frame, authorities)


def names_of(pairs: DataFrame) -> DataFrame:
    """Each cleaned name of either kind once, as ``kind, name``."""
    columns = zip(KINDS, ("sci_clean", "comm_clean"))
    long = pairs.select(
        F.inline(
            F.array(
                *(F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in columns)
            )
        )
    )
    return long.where(F.col("name").isNotNull()).distinct()


def search_names(names: DataFrame, authorities: Authorities) -> DataFrame:
    """As ``search_all`` for written ``kind, name`` rows."""

    def both(search: Callable[[DataFrame, Authorities, str], DataFrame]) -> DataFrame:
        sci, comm = (
            search(names.where(F.col("kind") == k).select("name"), authorities, k)
            for k in KINDS
        )
        return sci.unionByName(comm)

    def ranked(decided: DataFrame, ranks: dict[str, int]) -> DataFrame:
        is_sci = F.col("code_src") == "scientific"
        return decided.withColumn(
            "rank", F.when(is_sci, ranks["scientific"]).otherwise(ranks["common"])
        )

    best = decide_best(verify_match(both(best_match), authorities))
    worms = decide_worms(both(search_worms))
    units = search_itis_shortest(names, authorities)
    units = with_accepted(with_usage(units, authorities), authorities)
    return (
        ranked(worms, WORMS_RANK)
        .unionByName(ranked(best, BEST_RANK), allowMissingColumns=True)
        .unionByName(ranked(decide_itis(units), ITIS_RANK), allowMissingColumns=True)
    )


def cross_all(
    decided: DataFrame, authorities: Authorities, checked: DataFrame | None = None
) -> DataFrame:
    """What every code that may be definitive leads to in the other code type.

    Besides the definitive codes, one of several records can become so by its spelling.
    Where a code leads to definitive ones, its other links are dropped. Codes that the
    saved links ``checked`` answer are not looked up; their answers are taken from there.
    """
    sent = codes_to_send(decided)
    if checked is not None:
        sent = unchecked_codes(sent, sent_before(checked))
    links = cross_codes(sent, authorities)
    return links if checked is None else links.unionByName(checked.select(*links.columns))


def codes_to_send(decided: DataFrame) -> DataFrame:
    """The ``code_type, code`` of candidates that are, or may become, definitive."""
    may_be = F.col("code_definitive") | F.coalesce("several", F.lit(False))
    return decided.where(may_be & F.col("code").isNotNull()).select("code_type", "code").distinct()


def cross_codes(sent: DataFrame, authorities: Authorities) -> DataFrame:
    """What each distinct ``code_type, code`` leads to in the other code type."""
    aphias = distinct_keys(sent.where(F.col("code_type") == APHIAID), "code", "code")
    tsns = distinct_keys(sent.where(F.col("code_type") == TSN), "code", "code")
    links = tsn_links(aphias, authorities).unionByName(aphia_links(tsns, authorities))
    return keep_if_any(links, ["sent", "code_type"], F.col("code_definitive"))


def sent_before(links: DataFrame) -> DataFrame:
    """The ``(code_type, code)`` pairs that saved links answer."""
    other = F.when(F.col("code_type") == TSN, APHIAID).otherwise(TSN)
    return links.select(other.alias("code_type"), F.col("sent").alias("code")).distinct()


def _counts(rows: DataFrame, **keys: str) -> Callable[[], DataFrame]:
    """One count per row, under the lookup's key names; computed only when asked for."""
    one = F.lit(1).cast("bigint").alias("n")
    return lambda: rows.select(*(F.col(c).alias(k) for k, c in keys.items()), one)
