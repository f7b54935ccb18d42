"""Every registered query with the SQL that states its result.

Single rules run on the lazily derived snapshots; whole resolutions on written ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import nomenlink as nl
from nomenlink.functions.cleaning import eligible, token_count
from nomenlink.functions.rules import KINDS
from nomenlink.operators.lookups import (
    best_match,
    derive_best_match,
    distinct_keys,
    search_itis,
    search_itis_shortest,
    search_worms,
    verify_match,
    with_accepted,
    with_usage,
)
from nomenlink.operators.policies import CODE_COLUMNS, TSN, APHIAID
from nomenlink.plans.resolve import resolve_pairs, search_all
from nomenlink.sources.staging import shared_dir, stage

from . import fixtures as fx
from .oracles import USER_FILTERS, VERSION_STAMP, query

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str, **instead: str) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        ORACLES[run.__name__] = query(sql, **instead)
        return run

    return add


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture rows as ``id, sci_clean, comm_clean``, at least one not null."""
    # The tables may come in few parts, and cleaning is the most work on a row.
    rows = fx.names(spark, sf_dir).repartition("row_key")
    rows = nl.strip_redundant(rows, "sci_name", "comm_name", "own")
    rows = nl.clean_names(rows, "sci_name", "scientific", output="sci_clean")
    rows = nl.clean_names(rows, "own", "common", output="comm_clean")
    rows = rows.select(F.col("row_key").alias("id"), "sci_clean", "comm_clean")
    return rows.where(eligible(F.col("sci_clean"), F.col("comm_clean")))


def both_kinds(rows: DataFrame, search, authorities: nl.Authorities) -> DataFrame:
    columns = {"scientific": "sci_clean", "common": "comm_clean"}
    sci, comm = (search(distinct_keys(rows, columns[k]), authorities, k) for k in KINDS)
    return sci.unionByName(comm)


def kinds_of_names(rows: DataFrame) -> DataFrame:
    """Each name of either kind once, as ``kind, name``."""
    sci, comm = (
        distinct_keys(rows, c).withColumn("kind", F.lit(k)) for k, c in zip(KINDS, ("sci_clean", "comm_clean"))
    )
    return sci.unionByName(comm)


# --- sources -----------------------------------------------------------------------


@register("SELECT row_number() OVER (ORDER BY row_key) AS id, row_key, sci_name FROM fx_names")
def surrogate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.names(spark, sf_dir).select("row_key", "sci_name")
    return nl.with_row_id(rows, order_by=["row_key"])


# --- cleaning ----------------------------------------------------------------------


@register("SELECT row_key, sci_name, comm_name, comm_own FROM own")
def strip_redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nl.strip_redundant(fx.names(spark, sf_dir), "sci_name", "comm_name", "comm_own")


@register(
    "SELECT row_key, sci_name, x AS cleaned FROM fx_names LEFT JOIN cl_sci ON sci_name = raw"
)
def clean_scientific(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.names(spark, sf_dir).select("row_key", "sci_name")
    return nl.clean_names(rows, "sci_name", "scientific", output="cleaned")


@register(
    "SELECT row_key, comm_name, x AS cleaned FROM fx_names LEFT JOIN cl_comm ON comm_name = raw"
)
def clean_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.names(spark, sf_dir).select("row_key", "comm_name")
    return nl.clean_names(rows, "comm_name", "common", output="cleaned")


@register(
    """SELECT row_key, s.x AS sci_clean, c.x AS comm_clean FROM fx_names
LEFT JOIN cl_user_sci s ON sci_name = s.raw LEFT JOIN cl_user_comm c ON comm_name = c.raw"""
)
def clean_user_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.names(spark, sf_dir)
    rows = nl.clean_names(rows, "sci_name", "scientific", USER_FILTERS, "sci_clean")
    rows = nl.clean_names(rows, "comm_name", "common", USER_FILTERS, "comm_clean")
    return rows.select("row_key", "sci_clean", "comm_clean")


@register("SELECT id, sci AS sci_clean, comm AS comm_clean FROM input")
def eligible_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir)


@register(
    """SELECT id, sci AS sci_clean, length(sci) - length(replace(sci, ' ', '')) + 1 AS words
FROM cleaned WHERE sci IS NOT NULL"""
)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaned(spark, sf_dir).where(F.col("sci_clean").isNotNull())
    words = token_count(F.col("sci_clean")).cast("bigint")
    return rows.select("id", "sci_clean", words.alias("words"))


# --- searches ----------------------------------------------------------------------


@register(
    """SELECT i.id, f.status, f.code, f.sugg AS spelling
FROM input i JOIN found_worms f ON f.kind = 'scientific' AND f.name = i.sci"""
)
def distinct_lookup_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaned(spark, sf_dir)
    found = search_worms(
        distinct_keys(rows, "sci_clean"), fx.authorities(spark, sf_dir), "scientific"
    )
    return rows.join(found, rows["sci_clean"] == found["name"]).select(
        "id", "status", F.col("valid_aphia_id").alias("code"),
        F.col("valid_name").alias("spelling"),
    )


@register("SELECT name, kind, status, code, sugg AS spelling FROM found_worms")
def worms_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = both_kinds(cleaned(spark, sf_dir), search_worms, fx.authorities(spark, sf_dir))
    return found.select(
        "name", "kind", "status", F.col("valid_aphia_id").alias("code"),
        F.col("valid_name").alias("spelling"),
    )


@register(
    """SELECT f.name, f.kind, f.tsn, f.found_name, f.ok AS is_valid, s.accepted_tsn, s.accepted_name
FROM (SELECT i.*, EXISTS (SELECT 1 FROM fx_itis_units u
        WHERE u.tsn = i.tsn AND u.usage_rating = 'valid') AS ok FROM found_itis i) f
LEFT JOIN fx_itis_synonyms s ON s.tsn = f.tsn"""
)
def itis_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = fx.authorities(spark, sf_dir)
    found = search_itis(kinds_of_names(cleaned(spark, sf_dir)), snapshots)
    return with_accepted(with_usage(found, snapshots), snapshots).select(
        "name", "kind", "tsn", "found_name", "is_valid", "accepted_tsn", "accepted_name"
    )


@register(
    """SELECT name, kind, aphia_id, multiple_matches, pattern_match, code AS valid_aphia_id,
  sugg AS valid_name FROM found_best"""
)
def best_match_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = fx.authorities(spark, sf_dir)
    found = both_kinds(cleaned(spark, sf_dir), best_match, snapshots)
    return verify_match(found, snapshots)


@register(
    """SELECT q.name, 'scientific' AS kind, min_by(t.aphia_id, (t.scientificname <> q.name, t.aphia_id)) AS aphia_id,
  count(*) > 1 AS multiple_matches, NOT bool_or(t.scientificname = q.name) AS pattern_match
FROM (SELECT DISTINCT nm AS name FROM fx_base UNION SELECT DISTINCT adj FROM fx_base
      UNION SELECT DISTINCT left(nm, 6) FROM fx_base) q
JOIN fx_worms_taxa t ON starts_with(t.scientificname, q.name)
GROUP BY q.name"""
)
def best_match_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole names, first words and cut-off names against the taxa themselves."""
    part = fx.table(spark, sf_dir, "part").select(F.upper("p_name").alias("nm"))
    asked = part.select(
        F.explode(
            F.array("nm", F.split_part("nm", F.lit(" "), F.lit(1)), F.left("nm", F.lit(6)))
        ).alias("name")
    )
    names = distinct_keys(asked, "name")
    return derive_best_match(names, fx.authorities(spark, sf_dir, best=False), "scientific")


# --- policies ----------------------------------------------------------------------

_DECIDED = "b.code, '{svc}' AS code_svc, '{type}' AS code_type, b.sure AS code_definitive, {src} AS code_src, b.sugg AS sugg_spelling"


@register(
    "SELECT name, " + _DECIDED.format(svc="TAXIZE & WORRMS", type=APHIAID, src="b.kind")
    + " FROM by_best b"
)
def best_match_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = fx.authorities(spark, sf_dir)
    found = both_kinds(cleaned(spark, sf_dir), best_match, snapshots)
    return nl.decide_best(verify_match(found, snapshots))


@register(
    "SELECT name, " + _DECIDED.format(svc="WORRMS", type=APHIAID, src="b.kind")
    + ", b.several FROM by_worms b"
)
def worms_name_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = both_kinds(cleaned(spark, sf_dir), search_worms, fx.authorities(spark, sf_dir))
    return nl.decide_worms(found)


@register(
    "SELECT id, " + _DECIDED.format(svc="WORRMS", type=APHIAID, src="'common'")
    + " FROM worms_judged b"
)
def worms_common_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaned(spark, sf_dir)
    found = search_worms(
        distinct_keys(rows, "comm_clean"), fx.authorities(spark, sf_dir), "common"
    )
    return nl.decide_worms_common(rows, nl.decide_worms(found))


@register(
    "SELECT name, " + _DECIDED.format(svc="RITIS", type=TSN, src="b.kind") + " FROM by_itis b"
)
def itis_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the search that the whole resolution uses."""
    snapshots = fx.authorities(spark, sf_dir)
    names = stage(kinds_of_names(cleaned(spark, sf_dir)), "names").frame
    found = search_itis_shortest(names, snapshots)
    return nl.decide_itis(with_accepted(with_usage(found, snapshots), snapshots))


@register(
    "SELECT name, " + _DECIDED.format(svc="RITIS", type=TSN, src="b.kind") + " FROM by_itis b"
)
def itis_policy_all_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By all units that a name leads to."""
    return nl.decide_itis(itis_search(spark, sf_dir))


@register(
    """SELECT f.* FROM found_itis f WHERE f.found_name = f.name OR NOT EXISTS (
  SELECT 1 FROM found_itis g WHERE g.name = f.name AND g.kind = f.kind AND g.found_name = g.name)"""
)
def keep_if_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = kinds_of_names(cleaned(spark, sf_dir))
    found = search_itis(names, fx.authorities(spark, sf_dir))
    return nl.keep_if_any(found, ["name", "kind"], F.col("found_name") == F.col("name"))


# --- crosswalks --------------------------------------------------------------------


@register(
    """SELECT i.id, x.code, 'WORRMS' AS code_svc, 'TSN' AS code_type, x.sure AS code_definitive,
  'APHIAID' AS code_src, x.sugg AS sugg_spelling
FROM input i JOIN by_worms b ON b.kind = 'scientific' AND b.name = i.sci JOIN x_tsn x ON x.sent = b.code"""
)
def xwalk_tsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, snapshots = cleaned(spark, sf_dir), fx.authorities(spark, sf_dir)
    found = search_worms(distinct_keys(rows, "sci_clean"), snapshots, "scientific")
    coded = nl.decide_worms(found).select("name", "code")
    coded = rows.join(coded, rows["sci_clean"] == coded["name"]).select("id", "code")
    return nl.xwalk_tsn(coded, snapshots)


@register(
    """SELECT i.id, x.code, 'WORRMS' AS code_svc, 'APHIAID' AS code_type, x.sure AS code_definitive,
  'TSN' AS code_src, x.sugg AS sugg_spelling
FROM input i JOIN by_itis b ON b.kind = 'scientific' AND b.name = i.sci JOIN x_aphia x ON x.sent = b.code"""
)
def xwalk_aphia(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, snapshots = cleaned(spark, sf_dir), fx.authorities(spark, sf_dir)
    found = search_itis(distinct_keys(rows, "sci_clean"), snapshots, "scientific")
    found = with_accepted(with_usage(found, snapshots), snapshots)
    coded = nl.decide_itis(found).select("name", "code")
    coded = rows.join(coded, rows["sci_clean"] == coded["name"]).select("id", "code")
    return nl.xwalk_aphia(coded, snapshots)


@register(
    """SELECT DISTINCT b.code, 'APHIAID' AS code_type FROM by_worms b
WHERE b.code IS NOT NULL AND NOT EXISTS (SELECT 1 FROM by_best c WHERE c.code = b.code)"""
)
def unchecked_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes that only the WoRMS search gave, after those of the best matches."""
    found = search_all(cleaned(spark, sf_dir), fx.authorities(spark, sf_dir))
    found = found.select("code", "code_type", "code_svc").where(
        F.col("code").isNotNull() & (F.col("code_type") == APHIAID)
    )
    first = found.where(F.col("code_svc") == "TAXIZE & WORRMS")
    later = found.where(F.col("code_svc") == "WORRMS")
    codes = later.select("code", "code_type").distinct()
    return nl.unchecked_codes(codes, first.select("code_type", "code").distinct())


# --- work on candidates ------------------------------------------------------------


def all_found(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Every answer of every name search, for every row, before any is chosen.

    ``rows`` may give the cleaned rows, written already.
    """
    rows = stage(cleaned(spark, sf_dir), "rows").frame if rows is None else rows
    found = stage(search_all(rows, fx.authorities(spark, sf_dir, written=True)), "found").frame
    long = rows.select(
        "id", "sci_clean", "comm_clean",
        F.explode(
            F.create_map(
                F.lit("scientific"), "sci_clean", F.lit("common"), "comm_clean"
            )
        ).alias("code_src", "name"),
    )
    return long.join(found, ["code_src", "name"]).select(
        "id", "sci_clean", "comm_clean", "rank", *CODE_COLUMNS
    )


_FOUND = "id, code, {svc} AS code_svc, type AS code_type, sure AS code_definitive, src AS code_src, {sugg} AS sugg_spelling"


@register(
    "SELECT DISTINCT " + _FOUND.format(svc="svc", sugg="sugg") + ", true AS is_known FROM all_found WHERE sure "
    "UNION ALL SELECT " + _FOUND.format(svc="string_agg(DISTINCT svc, ',' ORDER BY svc)", sugg="sugg")
    + """, false FROM all_found a WHERE NOT sure AND NOT EXISTS (
  SELECT 1 FROM all_found b WHERE b.id = a.id AND b.type = a.type AND b.sure)
GROUP BY id, code, type, sure, src, sugg"""
)
def split_known_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = all_found(spark, sf_dir).select("id", *CODE_COLUMNS)
    known, unknown = nl.split_known_unknown(found)
    return known.withColumn("is_known", F.lit(True)).unionByName(
        unknown.withColumn("is_known", F.lit(False))
    )


@register(
    "SELECT DISTINCT " + _FOUND.format(svc="svc", sugg="sugg") + """, i.sci AS sci_clean,
  i.comm AS comm_clean, true AS is_known
FROM all_found a JOIN input i USING (id) WHERE sure AND id % 3 <> 0 UNION ALL SELECT a.id, """
    + _FOUND.format(svc="string_agg(DISTINCT svc, ',' ORDER BY svc)", sugg="sugg").removeprefix("id, ")
    + """, i.sci, i.comm, false
FROM (SELECT * FROM input WHERE id % 3 <> 0) i RIGHT JOIN all_found a ON a.id = i.id
WHERE NOT sure AND NOT EXISTS (
  SELECT 1 FROM all_found b WHERE b.id = a.id AND b.type = a.type AND b.sure AND b.id % 3 <> 0)
GROUP BY a.id, code, type, sure, src, sugg, i.sci, i.comm"""
)
def split_with_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split with a master list that lacks a third of the ids."""
    rows = stage(cleaned(spark, sf_dir), "rows").frame
    found = all_found(spark, sf_dir, rows)
    master = rows.where("id % 3 <> 0")
    known, unknown = nl.split_known_unknown(found.select("id", *CODE_COLUMNS), master)
    known = known.withColumn("is_known", F.lit(True))
    return known.unionByName(unknown.withColumn("is_known", F.lit(False))).select(
        "id", *CODE_COLUMNS, "sci_clean", "comm_clean", "is_known"
    )


@register(
    """SELECT id, sci AS sci_clean, comm AS comm_clean, CASE id % 4
  WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN sci || ' (COMMON)' ELSE 'OTHER ' || comm END AS sugg_spelling
FROM input WHERE sci IS NOT NULL AND comm IS NOT NULL AND sci <> comm"""
)
def marked_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions that repeat a name behind its marker are dropped, others stay."""
    rows = cleaned(spark, sf_dir).where("sci_clean <> comm_clean")
    sugg = (
        F.when(F.col("id") % 4 == 0, F.concat("sci_clean", F.lit(" (SCIENTIFIC)")))
        .when(F.col("id") % 4 == 1, F.concat(F.lit("(COMMON) "), F.col("comm_clean")))
        .when(F.col("id") % 4 == 2, F.concat("sci_clean", F.lit(" (COMMON)")))
        .otherwise(F.concat(F.lit("OTHER "), F.col("comm_clean")))
    )
    return nl.review_spelling(rows.withColumn("sugg_spelling", sugg))


@register(
    """SELECT id, code, string_agg(DISTINCT svc, ',' ORDER BY svc) AS code_svc, type AS code_type
FROM all_found GROUP BY id, code, type"""
)
def combine_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The services that agree on a code of a row, whatever they say of it."""
    found = all_found(spark, sf_dir).select("id", "code", "code_svc", "code_type")
    return nl.combine_services(found)


@register(
    "SELECT " + _FOUND.format(svc="svc", sugg="s") + """ FROM (
  SELECT a.*, CASE WHEN a.sugg = i.sci OR a.sugg = i.comm THEN NULL ELSE a.sugg END AS s
  FROM all_found a JOIN input i ON i.id = a.id) r
WHERE sure OR s IS NULL OR NOT EXISTS (
  SELECT 1 FROM all_found b JOIN input j ON j.id = b.id
  WHERE b.id = r.id AND b.type = r.type
    AND (b.sure OR b.sugg IS NULL OR b.sugg = j.sci OR b.sugg = j.comm))"""
)
def spelling_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviewed = nl.review_spelling(all_found(spark, sf_dir))
    return nl.prefer_exact_spelling(reviewed).select("id", *CODE_COLUMNS)


@register(
    """SELECT id, type AS code_type, code, r AS rank, sure AS code_definitive FROM (
  SELECT a.*, CASE svc WHEN 'WORRMS' THEN 2 WHEN 'RITIS' THEN 2 ELSE 1 END
    + CASE src WHEN 'common' THEN CASE type WHEN 'TSN' THEN 2 ELSE 3 END ELSE 0 END AS r
  FROM all_found a WHERE code IS NOT NULL) f
WHERE CASE WHEN EXISTS (SELECT 1 FROM all_found s WHERE s.id = f.id AND s.type = f.type AND s.sure)
  THEN sure AND NOT EXISTS (SELECT 1 FROM all_found s WHERE s.id = f.id AND s.type = f.type AND s.sure
    AND (CASE s.svc WHEN 'WORRMS' THEN 2 WHEN 'RITIS' THEN 2 ELSE 1 END + CASE s.src WHEN 'common' THEN CASE s.type WHEN 'TSN' THEN 2 ELSE 3 END ELSE 0 END) < f.r)
  ELSE NOT EXISTS (SELECT 1 FROM all_found s WHERE s.id = f.id AND s.type = f.type AND s.code IS NOT NULL
    AND (CASE s.svc WHEN 'WORRMS' THEN 2 WHEN 'RITIS' THEN 2 ELSE 1 END + CASE s.src WHEN 'common' THEN CASE s.type WHEN 'TSN' THEN 2 ELSE 3 END ELSE 0 END) > f.r)
  END"""
)
def select_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first definitive answer of the name searches, else the last one."""
    chosen = nl.select_candidates(all_found(spark, sf_dir), ["id"])
    return chosen.select("id", "code_type", "code", "rank", "code_definitive")


# --- whole resolutions -------------------------------------------------------------


def chosen(spark: SparkSession, sf_dir: str, code_type: str) -> DataFrame:
    rows = stage(cleaned(spark, sf_dir), "rows").frame
    found = resolve_pairs(rows, fx.authorities(spark, sf_dir, written=True)).frame
    return found.where(F.col("code_type") == code_type)


_FINAL = "SELECT " + _FOUND.format(svc="svc", sugg="sugg") + " FROM final WHERE type = '{}'"


@register(_FINAL.format(APHIAID))
def cascade_aphia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spark, sf_dir, APHIAID)


@register(_FINAL.format(TSN))
def cascade_tsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spark, sf_dir, TSN)


def resolved(
    spark: SparkSession, sf_dir: str, rows: DataFrame, only: str | None = None
) -> nl.Resolved:
    return nl.resolve_names(
        rows, fx.authorities(spark, sf_dir, written=True), "sci_name", "comm_name", only=only
    )


@register(f"SELECT w.*, '{VERSION_STAMP}' AS id_src FROM wide w")
def resolved_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir, fx.names(spark, sf_dir), "resolved").resolved


_REPORT = """f.code AS code_sugg, f.svc AS code_svc, f.type AS code_type, f.sure AS code_definitive,
  f.src AS code_src, f.sugg AS sugg_spelling"""


@register(
    f"""SELECT n.*, {_REPORT}, '{VERSION_STAMP}' AS id_src
FROM fx_names n JOIN final f ON f.id = n.row_key
WHERE (f.id, f.type) IN (SELECT (id, type) FROM final GROUP BY id, type HAVING count(*) > 1)"""
)
def ambiguous_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir, fx.names(spark, sf_dir), "ambiguous").ambiguous


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line with the dirty names of its part: few names, many rows."""
    lines = fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )
    names = fx.names(spark, sf_dir)
    return lines.join(names, lines["l_partkey"] == names["row_key"]).drop("row_key")


@register(
    f"""SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, w.* EXCLUDE (row_key), '{VERSION_STAMP}' AS id_src
FROM lineitem l JOIN wide w ON w.row_key = l.l_partkey"""
)
def resolved_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir, order_lines(spark, sf_dir), "resolved").resolved


@register(
    f"""SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, n.sci_name, n.comm_name, {_REPORT}, '{VERSION_STAMP}' AS id_src
FROM lineitem l JOIN fx_names n ON n.row_key = l.l_partkey JOIN final f ON f.id = n.row_key
WHERE (f.id, f.type) IN (SELECT (id, type) FROM final GROUP BY id, type HAVING count(*) > 1)"""
)
def ambiguous_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir, order_lines(spark, sf_dir), "ambiguous").ambiguous


@register(
    """SELECT l.l_orderkey, l.l_linenumber, w.aphiaid AS code, w.aphiaid_multi_flag AS flag, 'wide' AS result
FROM lineitem l JOIN wide w ON w.row_key = l.l_partkey
UNION ALL
SELECT l.l_orderkey, l.l_linenumber, f.code, f.sure, f.type
FROM lineitem l JOIN final f ON f.id = l.l_partkey
WHERE (f.id, f.type) IN (SELECT (id, type) FROM final GROUP BY id, type HAVING count(*) > 1)"""
)
def both_results_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both results of one run, one under the other."""
    found = resolved(spark, sf_dir, order_lines(spark, sf_dir))
    key = ("l_orderkey", "l_linenumber")
    wide = found.resolved.select(
        *key, F.col("aphiaid").alias("code"), F.col("aphiaid_multi_flag").alias("flag"),
        F.lit("wide").alias("result"),
    )
    report = found.ambiguous.select(
        *key, F.col("code_sugg").alias("code"), F.col("code_definitive").alias("flag"),
        F.col("code_type").alias("result"),
    )
    return wide.unionByName(report)


@register(
    """SELECT DISTINCT 'APHIAID' AS code_type, code FROM da1
UNION SELECT 'APHIAID', code FROM new_aphia WHERE id NOT IN (SELECT id FROM dt2)
UNION SELECT 'TSN', code FROM dt2 WHERE id NOT IN (SELECT id FROM da1)
UNION SELECT 'TSN', code FROM new_tsn WHERE id NOT IN (SELECT id FROM da3)"""
)
def sent_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes to leave out of the crosswalk of a later run."""
    return nl.sent_codes(resolved(spark, sf_dir, fx.names(spark, sf_dir)).resolved)


@register(f"SELECT w.*, '{VERSION_STAMP}' AS id_src FROM wide w")
def resolved_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole resolution with nothing small enough to broadcast."""
    return nl.resolve_names(
        fx.names(spark, sf_dir), fx.authorities(spark, sf_dir, written=True),
        "sci_name", "comm_name", broadcast_bytes=0, only="resolved",
    ).resolved


@register(f"SELECT w.*, '{VERSION_STAMP}' AS id_src FROM wide w")
def resolved_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole resolution over snapshots written in the layout of their lookups."""
    folder = f"{shared_dir(spark)}/nomenlink/{uuid.uuid4().hex}/prepared"
    prepared = nl.PreparedAuthorities.prepare(fx.authorities(spark, sf_dir, written=True), folder)
    return nl.resolve_names(
        fx.names(spark, sf_dir), prepared, "sci_name", "comm_name", only="resolved"
    ).resolved


@register(f"SELECT w.*, '{VERSION_STAMP}' AS id_src FROM wide w")
def resolved_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole resolution, started again over the steps that a first start wrote."""
    rows, snapshots = fx.names(spark, sf_dir), fx.authorities(spark, sf_dir, written=True)
    folder = f"{shared_dir(spark)}/nomenlink/{uuid.uuid4().hex}/runs"
    columns = {"sci_col": "sci_name", "comm_col": "comm_name", "only": "resolved"}
    _, first = nl.resolve_resumably(rows, snapshots, folder, **columns)
    found, again = nl.resolve_resumably(rows, snapshots, folder, **columns)
    if again.made or again.reused != first.made:
        raise RuntimeError("the second start did not take the steps of the first one")
    return found.resolved


@register(f"SELECT w.*, '{VERSION_STAMP}' AS id_src FROM wide w")
def resolved_second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names, after a run over the customers' alone whose crosswalk answers are kept."""
    rows, snapshots = fx.names(spark, sf_dir), fx.authorities(spark, sf_dir, written=True)
    first = nl.resolve_names(rows.where("row_key > 10000000"), snapshots, "sci_name", "comm_name")
    return nl.resolve_names(
        rows, snapshots, "sci_name", "comm_name", checked=first.links, only="resolved"
    ).resolved


@register(f"SELECT w.*, '{VERSION_STAMP}' AS id_src FROM wide w")
def resolved_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names, over a store that knows the customers' from snapshots of before.

    Since then, records were accepted and crosswalk lines added and dropped.
    """
    rows, now = fx.names(spark, sf_dir), fx.authorities(spark, sf_dir, written=True)
    old_status = F.when(F.col("aphia_id") % 50 == 3, "unaccepted").otherwise(F.col("status"))
    before = replace(
        now,
        worms_taxa=now.worms_taxa.withColumn("status", old_status),
        xwalk=now.xwalk.where("tsn % 40 <> 7").unionByName(
            now.xwalk.where("tsn % 40 = 9").withColumn("tsn", F.col("tsn") + 1)
        ),
    )
    store = nl.AnswerStore.create(spark, f"{shared_dir(spark)}/nomenlink/{uuid.uuid4().hex}/store")
    known = rows.where("row_key > 10000000")
    nl.resolve_incrementally(known, before, store, "sci_name", "comm_name", only="resolved")
    return nl.resolve_incrementally(
        rows, now, store, "sci_name", "comm_name", only="resolved"
    ).resolved


@register(
    """SELECT w.row_key, w.sci_name, w.aphiaid, w.aphiaid_definitive, w.tsn, w.tsn_definitive,
  w.aphiaid_multi_flag, w.tsn_multi_flag, 'nomenlink.resolve_names (DEBUG)' AS id_src
FROM wide w""",
    fx_names=f"SELECT row_key, sci_name, CAST(NULL AS VARCHAR) AS comm_name FROM ({fx.FIXTURE_SQL['fx_names']})",
)
def resolved_one_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows by their scientific names alone, with the debug stamp."""
    rows = fx.names(spark, sf_dir).select("row_key", "sci_name")
    found = nl.resolve_names(
        rows, fx.authorities(spark, sf_dir, written=True), sci_col="sci_name", debug=True,
        only="resolved",
    )
    return found.resolved.select(
        "row_key", "sci_name", "aphiaid", "aphiaid_definitive", "tsn", "tsn_definitive",
        "aphiaid_multi_flag", "tsn_multi_flag", "id_src",
    )


@register(
    f"""SELECT n.*, {_REPORT}, '{VERSION_STAMP}' AS id_src
FROM fx_names n RIGHT JOIN final f ON f.id = n.row_key
WHERE (f.id, f.type) IN (SELECT (id, type) FROM final GROUP BY id, type HAVING count(*) > 1)"""
)
def assembled_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ambiguous candidates put together by row id."""
    found = resolve_pairs(
        stage(cleaned(spark, sf_dir), "rows").frame,
        fx.authorities(spark, sf_dir, written=True),
    ).frame
    rows = fx.names(spark, sf_dir).withColumn("id", F.col("row_key"))
    return nl.assemble(rows, found).ambiguous


@register("SELECT w.* EXCLUDE (sci_name, comm_name), w.sci_name, w.comm_name, "
          f"'{VERSION_STAMP}' AS id_src FROM wide w")
def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result put together by row id instead of by name pair."""
    found = resolve_pairs(
        stage(cleaned(spark, sf_dir), "rows").frame,
        fx.authorities(spark, sf_dir, written=True),
    ).frame
    rows = fx.names(spark, sf_dir).withColumn("id", F.col("row_key"))
    return nl.assemble(rows, found).resolved
