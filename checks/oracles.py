"""SQL that states the expected result of every query, for DuckDB.

The text is built from named views, each a materialised CTE over the views before it.
It follows the passes one after the other per input row, with anti joins and counted
subqueries, and applies every cleaning rule on its own: another shape than the jobs.
"""

from __future__ import annotations

import re

from .fixtures import FIXTURE_SQL

# --- fixed values: the cleaning rules one by one, with those that never change a name ---
_SHARED = [
    r"\bDOMAIN\b", r"\bKINGDOM\b", r"\bPHYLUM\b", r"\bDIVISION\b", r"\bSUBPHYLUM\b",
    r"\bSUBDIVISION\b", r"\bCLASS\b", r"\bSUBCLASS\b", r"\bSUPERORDER\b", r"\bORDER\b",
    r"\bSUBORDER\b", r"\bFAMILY\b", r"\bSUBFAMILY\b", r"\bGENUS\b", r"\bSPECIES\b",
    r"(\(NS\)|\bNS)", r"(-|,|\s)?UNIDENTIFIED.*", r"(\)|^|-|,|\s)?UNID(EN)?(T?)\.*",
    r"UNID\. FISH", r"([^'']\b[SP]{1,3}\.?$)", r"\b[a-zA-Z]{1,2}\.",
]
_LAST = {
    "scientific": [r"\bOBSOLETE\b", r"\bUNIDENTIFIED\b", r"\(.*?\)"],
    "common": [r"\(", r"\)"],
}
_DROP = (
    r"\b(BAIT|DIGESTED|NIDENTIFIED PER|UNIDENTIFIED SPECIES|UNID (FISH|REMAINS)+|REMAINS"
    r"|SURVEY|FSRS -|RESERVED|PURSE|INVERTEBRATE|EGG(S?)|INORGANIC DEBRIS|MIXED|MUCUS"
    r"|OPERCULUM|FLUID|LARVAE|AND)\b|\s?,?ETC\.?|^FISH$|^WATER$|^SHARK$|^SAND$"
)
_DROP_SCIENTIFIC = (
    r"|\b(WHALE|CRAB|LOBSTER|SHRIMP|IRISH MOSS|SHARK|COD WORM|CORALS|SKATE|FINFISHES"
    r"|GROUNDFISH|PELAGIC FISH|SAND TUBE)\b"
)
USER_FILTERS = (r"\bRED\b", r"GI(Z)+MO", r"[AO]LD ")

VIEWS: dict[str, str] = dict(FIXTURE_SQL)


def _clean(view: str, source: str, kind: str, extra: tuple[str, ...] = ()) -> None:
    """Define ``view(raw, x)``: the distinct values of a one-column query, cleaned."""
    drop = _DROP + (_DROP_SCIENTIFIC if kind == "scientific" else "")
    blank = "' ' || chr(9) || chr(10) || chr(13)"
    VIEWS[f"{view}_0"] = f"SELECT DISTINCT raw, upper(raw) AS x FROM ({source}) AS s(raw)"
    VIEWS[f"{view}_1"] = (
        f"SELECT raw, CASE WHEN regexp_matches(x, '{drop}') THEN NULL ELSE x END AS x "
        f"FROM {view}_0"
    )
    at = 1
    for rule in (*_SHARED, *extra, *_LAST[kind]):
        VIEWS[f"{view}_{at + 1}"] = (
            f"SELECT raw, trim(regexp_replace(regexp_replace(x, '{rule}', '', 'g'), ' +', ' ', 'g'), "
            f"{blank}) AS x FROM {view}_{at}"
        )
        at += 1
    turned = "x"
    if kind == "common":
        turned = (
            "CASE WHEN contains(x, ',') THEN trim(string_split(x, ',')[-1] || ' ' || "
            f"string_split(x, ',')[1], {blank}) ELSE x END"
        )
    VIEWS[f"{view}_{at + 1}"] = f"SELECT raw, {turned} AS x FROM {view}_{at}"
    VIEWS[view] = (
        f"SELECT raw, CASE WHEN length(x) < 4 THEN NULL ELSE x END AS x FROM {view}_{at + 1}"
    )


_clean("cl_sci", "SELECT sci_name FROM fx_names", "scientific")
_clean("cl_comm", "SELECT comm_name FROM fx_names", "common")
_clean("cl_user_sci", "SELECT sci_name FROM fx_names", "scientific", USER_FILTERS)
_clean("cl_user_comm", "SELECT comm_name FROM fx_names", "common", USER_FILTERS)
VIEWS["own"] = """
SELECT row_key, sci_name, comm_name,
  CASE WHEN sci_name IS NOT NULL AND contains(comm_name, sci_name)
       THEN replace(comm_name, sci_name, '') ELSE comm_name END AS comm_own
FROM fx_names"""
_clean("cl_own", "SELECT comm_own FROM own", "common")
VIEWS["cleaned"] = """
SELECT o.row_key AS id, s.x AS sci, c.x AS comm
FROM own o LEFT JOIN cl_sci s ON o.sci_name = s.raw LEFT JOIN cl_own c ON o.comm_own = c.raw"""
VIEWS["input"] = "SELECT * FROM cleaned WHERE sci IS NOT NULL OR comm IS NOT NULL"

# Searches: the names sent, and what each finds.
VIEWS["sent"] = """
SELECT DISTINCT sci AS name, 'scientific' AS kind FROM input WHERE sci IS NOT NULL
UNION ALL SELECT DISTINCT comm, 'common' FROM input WHERE comm IS NOT NULL"""
VIEWS["found_best"] = """
SELECT n.name, n.kind, b.aphia_id, b.multiple_matches, b.pattern_match,
  CASE WHEN t.valid_name IS NOT NULL THEN t.valid_aphia_id END AS code,
  CASE WHEN t.valid_aphia_id IS NOT NULL THEN t.valid_name END AS sugg
FROM sent n JOIN fx_best_match b ON b.query = n.name
LEFT JOIN fx_worms_taxa t ON t.aphia_id = b.aphia_id"""
VIEWS["found_worms"] = """
SELECT n.name, n.kind, t.status, t.valid_aphia_id AS code, t.valid_name AS sugg
FROM sent n JOIN fx_worms_taxa t ON t.scientificname = n.name WHERE n.kind = 'scientific'
UNION ALL
SELECT n.name, n.kind, t.status, t.valid_aphia_id, t.valid_name
FROM sent n, fx_worms_taxa t
WHERE n.kind = 'common' AND EXISTS (
  SELECT 1 FROM fx_worms_vernacular v WHERE v.vernacular = n.name AND v.aphia_id = t.aphia_id)"""
VIEWS["found_itis"] = """
SELECT DISTINCT n.name, n.kind, u.tsn, u.combined_name AS found_name
FROM sent n JOIN fx_itis_units u
  ON u.combined_name = n.name OR starts_with(u.combined_name, n.name || ' ')
WHERE n.kind = 'scientific'
UNION ALL
SELECT DISTINCT n.name, n.kind, u.tsn, u.common_name
FROM sent n JOIN fx_itis_units u
  ON u.common_name = n.name OR starts_with(u.common_name, n.name || ' ')
WHERE n.kind = 'common'"""

# Policies: ``name, kind, code, sure, sugg`` for each search.
VIEWS["by_best"] = """
SELECT name, kind, code, code IS NOT NULL AND pattern_match IS NOT DISTINCT FROM false AS sure, sugg
FROM found_best"""
VIEWS["worms_coded"] = """
SELECT f.* FROM found_worms f
WHERE f.code IS NOT NULL
   OR (SELECT count(*) FROM found_worms g
       WHERE g.name = f.name AND g.kind = f.kind AND g.code IS NOT NULL) <> 1"""
VIEWS["worms_status"] = """
SELECT f.*, (SELECT count(*) FROM worms_coded g WHERE g.name = f.name AND g.kind = f.kind) AS n
FROM worms_coded f
WHERE (SELECT count(*) FROM worms_coded g WHERE g.name = f.name AND g.kind = f.kind) = 1
   OR f.status = 'accepted'
   OR NOT EXISTS (SELECT 1 FROM worms_coded g
                  WHERE g.name = f.name AND g.kind = f.kind AND g.status = 'accepted')"""
VIEWS["by_worms"] = """
SELECT f.name, f.kind, f.code, f.sugg, f.n > 1 AS several,
  f.code IS NOT NULL AND (f.n = 1 OR (f.status = 'accepted' AND (
    SELECT count(*) FROM worms_status g WHERE g.name = f.name AND g.kind = f.kind) = 1)) AS sure
FROM worms_status f"""
VIEWS["itis_words"] = """
SELECT f.* FROM found_itis f
WHERE length(f.found_name) - length(replace(f.found_name, ' ', ''))
    = length(f.name) - length(replace(f.name, ' ', ''))
   OR NOT EXISTS (SELECT 1 FROM found_itis g WHERE g.name = f.name AND g.kind = f.kind
        AND length(g.found_name) - length(replace(g.found_name, ' ', ''))
          = length(g.name) - length(replace(g.name, ' ', '')))"""
VIEWS["itis_rated"] = """
SELECT f.*, EXISTS (SELECT 1 FROM fx_itis_units u
                    WHERE u.tsn = f.tsn AND u.usage_rating = 'valid') AS ok
FROM itis_words f"""
VIEWS["itis_accepted"] = """
SELECT f.name, f.kind, coalesce(s.accepted_tsn, f.tsn) AS code,
  CASE WHEN s.accepted_tsn IS NULL THEN f.found_name ELSE s.accepted_name END AS sugg
FROM itis_rated f LEFT JOIN fx_itis_synonyms s ON s.tsn = f.tsn
WHERE f.ok OR NOT EXISTS (
  SELECT 1 FROM itis_rated g WHERE g.name = f.name AND g.kind = f.kind AND g.ok)"""
VIEWS["itis_counted"] = """
SELECT a.*, (SELECT count(*) FROM itis_accepted g WHERE g.name = a.name AND g.kind = a.kind) AS n,
  (SELECT count(*) FROM itis_accepted g
   WHERE g.name = a.name AND g.kind = a.kind AND g.sugg = a.name) AS same
FROM itis_accepted a"""
VIEWS["by_itis"] = """
SELECT DISTINCT name, kind, code, sugg, n = 1 OR same = 1 AS sure
FROM itis_counted WHERE n = 1 OR same <> 1 OR sugg = name"""

# Crosswalks: ``sent, code, sure, sugg`` for each code that may be sent.
VIEWS["x_tsn"] = """
SELECT DISTINCT a.aphia_id AS sent, x.tsn AS code,
  EXISTS (SELECT 1 FROM fx_itis_units u WHERE u.tsn = x.tsn AND u.usage_rating = 'valid') AS sure,
  CAST(NULL AS VARCHAR) AS sugg
FROM (SELECT DISTINCT code AS aphia_id FROM by_best UNION SELECT DISTINCT code FROM by_worms) a
LEFT JOIN fx_xwalk x ON x.aphia_id = a.aphia_id
WHERE a.aphia_id IS NOT NULL"""
VIEWS["x_aphia"] = """
SELECT DISTINCT i.tsn AS sent, coalesce(t.valid_aphia_id, t.aphia_id) AS code,
  t.valid_aphia_id IS NOT NULL AND (
    SELECT count(DISTINCT y.aphia_id) FROM fx_xwalk y JOIN fx_worms_taxa u ON u.aphia_id = y.aphia_id
    WHERE y.tsn = i.tsn) = 1 AS sure,
  CASE WHEN t.valid_aphia_id IS NOT NULL THEN t.valid_name END AS sugg
FROM (SELECT DISTINCT code AS tsn FROM by_itis) i
LEFT JOIN (fx_xwalk x JOIN fx_worms_taxa t ON t.aphia_id = x.aphia_id) ON x.tsn = i.tsn"""

# The four passes over the rows. ``d``: definitive so far, ``m``: the doubtful answer.
_COLS = "id, code, svc, src, sugg"


def _doubt(view: str, done: str, *answers: str) -> None:
    """Doubtful rows of ids not done: those of the first answer that has any."""
    parts = []
    for at, answer in enumerate(answers):
        earlier = "".join(
            f" AND id NOT IN (SELECT id FROM {a})" for a in answers[:at]
        )
        parts.append(
            f"SELECT {_COLS} FROM {answer} WHERE id NOT IN (SELECT id FROM {done}){earlier}"
        )
    VIEWS[view] = " UNION ALL ".join(parts)


def _search(view: str, by: str, key: str, kind: str, svc: str, unless: str) -> None:
    VIEWS[view] = (
        f"SELECT i.id, b.code, '{svc}' AS svc, '{kind}' AS src, b.sugg, b.sure "
        f"FROM input i JOIN {by} b ON b.name = i.{key} AND b.kind = '{kind}' "
        f"WHERE b.code IS NOT NULL AND i.id NOT IN (SELECT id FROM {unless})"
    )


def _cross(view: str, links: str, src: str, sent: str, unless: str) -> None:
    VIEWS[view] = (
        f"SELECT s.id, x.code, 'WORRMS' AS svc, '{src}' AS src, x.sugg, x.sure "
        f"FROM {sent} s JOIN {links} x ON x.sent = s.code "
        f"WHERE x.code IS NOT NULL AND s.id NOT IN (SELECT id FROM {unless})"
    )


def _known(view: str, *parts: str) -> None:
    VIEWS[view] = " UNION ".join(
        f"SELECT {_COLS} FROM {p}" + (" WHERE sure" if p[0] in "at" else "") for p in parts
    )


VIEWS["nobody"] = "SELECT CAST(NULL AS BIGINT) AS id WHERE false"
_search("a1", "by_best", "sci", "scientific", "TAXIZE & WORRMS", "nobody")
_known("da_best", "a1")
_search("a2", "by_worms", "sci", "scientific", "WORRMS", "da_best")
_known("da1", "da_best", "a2")
_doubt("ma1", "da1", "a2", "a1")
_cross("t1", "x_tsn", "APHIAID", "da1", "nobody")
_known("dt1", "t1")
_doubt("mt1", "dt1", "t1")
_search("t2", "by_itis", "sci", "scientific", "RITIS", "dt1")
_known("dt2", "dt1", "t2")
_doubt("mt2", "dt2", "t2", "mt1")
_cross("a3", "x_aphia", "TSN", "dt2", "da1")
_known("da2", "da1", "a3")
_doubt("ma2", "da2", "a3", "ma1")
_search("a4", "by_best", "comm", "common", "TAXIZE & WORRMS", "da2")
_known("da_comm", "da2", "a4")
VIEWS["worms_rows"] = """
SELECT i.id, b.code, b.sugg, b.several, b.sure, i.sci,
  (SELECT count(*) FROM by_worms g WHERE g.name = i.comm AND g.kind = 'common'
     AND g.several AND g.sugg = i.sci) AS matching
FROM input i JOIN by_worms b ON b.name = i.comm AND b.kind = 'common'"""
VIEWS["worms_judged"] = """
SELECT id, code, 'WORRMS' AS svc, 'common' AS src, sugg,
  CASE matching WHEN 1 THEN code IS NOT NULL ELSE sure END AS sure
FROM worms_rows WHERE matching = 0 OR sugg = sci"""
VIEWS["a5"] = (
    "SELECT * FROM worms_judged WHERE code IS NOT NULL "
    "AND id NOT IN (SELECT id FROM da_comm)"
)
_known("da3", "da_comm", "a5")
_doubt("ma3", "da3", "a5", "a4", "ma2")
VIEWS["new_aphia"] = "SELECT * FROM da3 WHERE id NOT IN (SELECT id FROM da2)"
_cross("t3", "x_tsn", "APHIAID", "new_aphia", "dt2")
_known("dt3", "dt2", "t3")
_doubt("mt3", "dt3", "t3", "mt2")
_search("t4", "by_itis", "comm", "common", "RITIS", "dt3")
_known("dt4", "dt3", "t4")
_doubt("mt4", "dt4", "t4", "mt3")
VIEWS["new_tsn"] = "SELECT * FROM dt4 WHERE id NOT IN (SELECT id FROM dt3)"
_cross("a6", "x_aphia", "TSN", "new_tsn", "da3")
_known("da4", "da3", "a6")
_doubt("ma4", "da4", "a6", "ma3")

VIEWS["answers"] = f"""
SELECT {_COLS}, 'APHIAID' AS type, true AS sure FROM da4
UNION ALL SELECT {_COLS}, 'APHIAID', false FROM ma4
UNION ALL SELECT {_COLS}, 'TSN', true FROM dt4
UNION ALL SELECT {_COLS}, 'TSN', false FROM mt4"""
VIEWS["reviewed"] = """
SELECT a.id, a.type, a.code, a.svc, a.src, a.sure,
  CASE WHEN trim(replace(a.sugg, '(SCIENTIFIC)', '')) = i.sci
         OR trim(replace(a.sugg, '(COMMON)', '')) = i.comm THEN NULL ELSE a.sugg END AS sugg
FROM answers a JOIN input i ON i.id = a.id"""
VIEWS["final"] = """
SELECT id, type, code, src, sure, sugg, string_agg(DISTINCT svc, ',' ORDER BY svc) AS svc
FROM reviewed r
WHERE sure OR sugg IS NULL OR NOT EXISTS (
  SELECT 1 FROM reviewed g WHERE g.id = r.id AND g.type = r.type AND g.sugg IS NULL)
GROUP BY id, type, code, src, sure, sugg"""
VIEWS["wide"] = """
SELECT n.row_key, n.sci_name, n.comm_name,
  a.code AS aphiaid, a.svc AS aphiaid_svc, a.sure AS aphiaid_definitive, a.src AS aphiaid_src,
  a.sugg AS aphiaid_spelling,
  t.code AS tsn, t.svc AS tsn_svc, t.sure AS tsn_definitive, t.src AS tsn_src,
  t.sugg AS tsn_spelling,
  (SELECT count(*) FROM final f WHERE f.id = n.row_key AND f.type = 'APHIAID') > 1 AS aphiaid_multi_flag,
  (SELECT count(*) FROM final f WHERE f.id = n.row_key AND f.type = 'TSN') > 1 AS tsn_multi_flag
FROM fx_names n
LEFT JOIN final a ON a.id = n.row_key AND a.type = 'APHIAID'
  AND a.id NOT IN (SELECT id FROM final WHERE type = 'APHIAID' GROUP BY id HAVING count(*) > 1)
LEFT JOIN final t ON t.id = n.row_key AND t.type = 'TSN'
  AND t.id NOT IN (SELECT id FROM final WHERE type = 'TSN' GROUP BY id HAVING count(*) > 1)"""

# All answers of the name searches, whatever the passes make of them.
VIEWS["all_found"] = """
SELECT i.id, b.code, 'TAXIZE & WORRMS' AS svc, 'APHIAID' AS type, b.sure, b.kind AS src, b.sugg
FROM input i JOIN by_best b ON (b.kind = 'scientific' AND b.name = i.sci) OR (b.kind = 'common' AND b.name = i.comm)
UNION ALL
SELECT i.id, b.code, 'WORRMS', 'APHIAID', b.sure, b.kind, b.sugg
FROM input i JOIN by_worms b ON (b.kind = 'scientific' AND b.name = i.sci) OR (b.kind = 'common' AND b.name = i.comm)
UNION ALL
SELECT i.id, b.code, 'RITIS', 'TSN', b.sure, b.kind, b.sugg
FROM input i JOIN by_itis b ON (b.kind = 'scientific' AND b.name = i.sci) OR (b.kind = 'common' AND b.name = i.comm)"""

VERSION_STAMP = "nomenlink.resolve_names (v0.1.0)"


def query(text: str, **instead: str) -> str:
    """Put the views that a query needs, and all that those need, in front of it.

    ``instead`` gives some views another text.
    """
    views = VIEWS | instead
    order = list(views)
    needed, seen = [text], set()
    while needed:
        source = needed.pop()
        for name in order:
            if name not in seen and _mentions(source, name):
                seen.add(name)
                needed.append(views[name])
    parts = [f"{n} AS MATERIALIZED ({views[n].strip()})" for n in order if n in seen]
    return "WITH " + ",\n".join(parts) + "\n" + text.strip() if parts else text.strip()


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"(?:\bFROM|\bJOIN|,)\s+\(*{name}\b", text) is not None
