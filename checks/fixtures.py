"""Names and authority snapshots derived from the ``part`` and ``customer`` tables.

Parts give few names that many rows share; customers give a name of its own to every row,
with codes that no other row sends.

The same SQL text defines each view for Spark and for the check of its results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nomenlink.sources.authorities import Authorities
from nomenlink.sources.staging import stage

FIXTURE_SQL = {
    "fx_names": """
SELECT p_partkey AS row_key,
  CASE p_partkey % 8 WHEN 0 THEN p_name || ' (NS)' WHEN 1 THEN p_name || ' SP.'
    WHEN 2 THEN 'ORDER ' || p_name WHEN 3 THEN p_name || ' UNIDENTIFIED'
    WHEN 4 THEN p_name || ' (OBSOLETE)' WHEN 5 THEN NULL ELSE p_name END AS sci_name,
  CASE p_partkey % 7 WHEN 0 THEN split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1)
    WHEN 1 THEN p_name || ' EGGS' WHEN 2 THEN NULL WHEN 3 THEN p_name || ' (NS)'
    WHEN 4 THEN p_name || ' ' || lower(p_type) ELSE p_name END AS comm_name
FROM part
UNION ALL
SELECT 10000000 + c_custkey, CASE c_custkey % 3 WHEN 0 THEN NULL ELSE c_name END,
  CASE c_custkey % 2 WHEN 0 THEN replace(c_name, 'Customer', 'Client') END
FROM customer""",
    "fx_cust": """
SELECT c_custkey AS k, upper(c_name) AS nm, replace(upper(c_name), 'CUSTOMER', 'CLIENT') AS cm
FROM customer""",
    "fx_base": """
SELECT upper(p_name) AS nm, upper(split_part(p_name, ' ', 1)) AS adj, p_type AS kind,
  min(p_partkey) AS k
FROM part GROUP BY p_name, p_type""",
    "fx_worms_taxa": """
SELECT k AS aphia_id, nm AS scientificname,
  CASE WHEN adj IN ('RED', 'BLUE', 'OLD') THEN 'accepted'
       WHEN adj = 'HOT' AND kind = 'SMALL' THEN 'accepted' ELSE 'unaccepted' END AS status,
  CASE WHEN adj IN ('SMALL', 'LARGE') THEN k + 500000 WHEN adj = 'NEW' THEN NULL ELSE k END AS valid_aphia_id,
  CASE WHEN adj IN ('SMALL', 'LARGE') THEN 'VALID ' || nm WHEN adj = 'NEW' THEN NULL ELSE nm END AS valid_name
FROM fx_base
WHERE (adj IN ('RED', 'BLUE', 'SMALL', 'LARGE', 'NEW') AND kind = 'ECONOMY')
   OR (adj = 'HOT' AND kind IN ('ECONOMY', 'SMALL', 'PROMO'))
   OR (adj = 'OLD' AND kind IN ('ECONOMY', 'SMALL'))
UNION ALL
SELECT 20000000 + k, nm, CASE k % 5 WHEN 0 THEN 'unaccepted' ELSE 'accepted' END,
  CASE WHEN k % 7 = 0 THEN NULL ELSE 20000000 + k END, nm
FROM fx_cust WHERE k % 2 = 0""",
    "fx_worms_vernacular": """
SELECT aphia_id, scientificname AS vernacular FROM fx_worms_taxa
UNION ALL
SELECT aphia_id, 'COLD' || substr(scientificname, 4) AS vernacular FROM fx_worms_taxa
WHERE scientificname LIKE 'HOT %'
UNION ALL
SELECT aphia_id, 'RED' || substr(scientificname, 5) AS vernacular FROM fx_worms_taxa
WHERE scientificname LIKE 'BLUE %'
UNION ALL
SELECT 20000000 + 2 * k AS aphia_id, cm AS vernacular FROM fx_cust WHERE k % 4 = 0""",
    "fx_best_match": """
SELECT nm AS query, k AS aphia_id, adj = 'HOT' AS multiple_matches, adj = 'BLUE' AS pattern_match
FROM fx_base WHERE adj IN ('RED', 'BLUE', 'HOT') AND kind = 'ECONOMY'""",
    "fx_itis_units": """
SELECT 1000000 + k AS tsn, CASE WHEN kind = 'PROMO' THEN nm || ' MINOR' ELSE nm END AS combined_name,
  nm AS common_name,
  CASE kind WHEN 'ECONOMY' THEN 'valid' WHEN 'SMALL' THEN 'invalid' ELSE NULL END AS usage_rating
FROM fx_base
WHERE (adj IN ('COLD', 'HOT') AND kind IN ('ECONOMY', 'SMALL', 'PROMO'))
   OR (adj = 'NEW' AND kind = 'SMALL')
   OR (adj = 'SMALL' AND kind IN ('MEDIUM', 'LARGE'))
UNION ALL
SELECT 30000000 + k, nm, cm, CASE k % 4 WHEN 0 THEN 'invalid' ELSE 'valid' END
FROM fx_cust WHERE k % 3 <> 2""",
    "fx_itis_synonyms": """
SELECT 1000000 + s.k AS tsn, 1000000 + v.k AS accepted_tsn, v.nm AS accepted_name
FROM fx_base s JOIN fx_base v ON s.nm = v.nm AND v.kind = 'ECONOMY'
WHERE s.kind = 'SMALL'""",
    "fx_xwalk": """
SELECT aphia_id, 1000000 + aphia_id AS tsn FROM fx_worms_taxa WHERE scientificname NOT LIKE 'BLUE %'
UNION ALL
SELECT aphia_id, 2000000 + aphia_id AS tsn FROM fx_worms_taxa WHERE scientificname LIKE 'RED %'
UNION ALL
SELECT t.aphia_id, 1000000 + b.k AS tsn FROM fx_worms_taxa t JOIN fx_base b ON b.nm = t.scientificname
WHERE b.adj = 'HOT' AND b.kind = 'ECONOMY' AND t.aphia_id <> b.k AND length(b.nm) % 2 = 0
UNION ALL
SELECT 20000000 + k, 30000000 + k FROM fx_cust WHERE k % 6 = 0
UNION ALL
SELECT 20000000 + 2 * k, 30000000 + k FROM fx_cust WHERE k % 5 < 2""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty names: ``row_key, sci_name, comm_name``."""
    return spark.sql(
        FIXTURE_SQL["fx_names"]
        .replace("FROM part", "FROM {part}")
        .replace("FROM customer", "FROM {customer}"),
        part=table(spark, sf_dir, "part"),
        customer=table(spark, sf_dir, "customer"),
    )


def authorities(
    spark: SparkSession, sf_dir: str, best: bool = True, written: bool = False
) -> Authorities:
    """The snapshots. ``written`` stages what they come from, for plans that reread it."""
    base = spark.sql(
        FIXTURE_SQL["fx_base"].replace("FROM part", "FROM {part}"),
        part=table(spark, sf_dir, "part"),
    )
    cust = spark.sql(
        FIXTURE_SQL["fx_cust"].replace("FROM customer", "FROM {customer}"),
        customer=table(spark, sf_dir, "customer"),
    )
    if written:
        base = stage(base, "fixture_base").frame
        # The customers may come in few parts, which every snapshot would be read in.
        cust = stage(cust.repartition("k"), "fixture_cust").frame

    def view(name: str, **sources: DataFrame) -> DataFrame:
        text = FIXTURE_SQL[name]
        for source in sources:
            text = text.replace(f" fx_{source}", f" {{{source}}}")
        return spark.sql(text, **sources)

    taxa = view("fx_worms_taxa", base=base, cust=cust)
    units = view("fx_itis_units", base=base, cust=cust)
    return Authorities(
        worms_taxa=taxa,
        worms_vernacular=view("fx_worms_vernacular", worms_taxa=taxa, cust=cust),
        worms_best_match=view("fx_best_match", base=base) if best else None,
        itis_names=units.select("tsn", "combined_name"),
        itis_vernacular=units.select("tsn", "common_name"),
        itis_units=units.select("tsn", "usage_rating"),
        itis_synonyms=view("fx_itis_synonyms", base=base),
        xwalk=view("fx_xwalk", worms_taxa=taxa, base=base, cust=cust),
    )
