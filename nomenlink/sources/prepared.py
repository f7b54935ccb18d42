"""Snapshots written once in the layout that the searches join them by.

Each table is canonical, free of repeated lines and of lines that no search can meet, and
bucketed and sorted by the key of its lookup. A lookup then moves only its names or codes to
the buckets; the snapshot is neither made canonical nor shuffled again. Taxa and crosswalk
are looked up from two sides, so they are written in two orders.

A bucket is read by one task, so a table is bucketed only if no key fills more than
``HOT_BUCKETS`` mean buckets. The lines of other tables stay where they are; joins shuffle
them, and adaptive execution splits what a hot key makes large.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .authorities import Authorities
from .staging import written

# The largest share of a table that one key may have, in mean buckets.
HOT_BUCKETS = 4

# Written table -> (snapshot, key of its lookup, other columns without which no search meets a line).
_LAYOUT = {
    "worms_taxa": ("worms_taxa", "aphia_id", ()),
    "worms_taxa_by_name": ("worms_taxa", "scientificname", ()),
    "worms_vernacular": ("worms_vernacular", "vernacular", ()),
    "worms_best_match": ("worms_best_match", "query", ()),
    "itis_names": ("itis_names", "combined_name", ()),
    "itis_vernacular": ("itis_vernacular", "common_name", ()),
    "itis_units": ("itis_units", "tsn", ()),
    "itis_synonyms": ("itis_synonyms", "tsn", ()),
    "xwalk": ("xwalk", "aphia_id", ("tsn",)),
    "xwalk_by_tsn": ("xwalk", "tsn", ("aphia_id",)),
}
_LINES = "name string, columns string, key string, buckets int"


@dataclass(frozen=True)
class PreparedAuthorities(Authorities):
    """Snapshots in their written layout. A changed snapshot needs a new preparation."""

    worms_taxa_by_name: DataFrame | None = None
    xwalk_by_tsn: DataFrame | None = None

    def __post_init__(self) -> None:
        # The tables are canonical as written; anything put over them would hide the buckets.
        if self.worms_taxa_by_name is None or self.xwalk_by_tsn is None:
            raise ValueError("prepared snapshots come from prepare or open")

    @property
    def taxa_by_name(self) -> DataFrame:
        return self.worms_taxa_by_name

    @property
    def links_by_tsn(self) -> DataFrame:
        return self.xwalk_by_tsn

    def staged(self) -> PreparedAuthorities:
        """They are written already."""
        return self

    @classmethod
    def prepare(
        cls, authorities: Authorities, folder: str, buckets: int | None = None
    ) -> PreparedAuthorities:
        """Write the snapshots to an empty shared folder and open them.

        An ``aphia_id`` that is null, or that two different lines of the taxa have, is an
        error: one record would pass for several, and no name of it would be definitive.
        ``buckets`` is the session's number of shuffle partitions unless given.
        """
        spark = authorities.worms_taxa.sparkSession
        count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        sources = {source for source, _, _ in _LAYOUT.values()}
        snapshots = {
            n: written(getattr(authorities, n).distinct(), n)
            for n in sorted(sources)
            if getattr(authorities, n) is not None
        }
        _check_key(snapshots["worms_taxa"])
        lines = []
        for name, (source, key, others) in _LAYOUT.items():
            if source not in snapshots:
                continue
            rows = snapshots[source].dropna(subset=[key, *others])
            hot = _is_hot(rows, key, count)
            if hot:
                rows.write.parquet(f"{folder}/{name}")
            else:
                # One task writes one bucket, so a bucket is one sorted file.
                table = rows.repartition(count, key).write.bucketBy(count, key).sortBy(key)
                table.option("path", f"{folder}/{name}").saveAsTable(_table(folder, name))
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
            lines.append((name, columns, key, 0 if hot else count))
        # Written last: a folder without it is not whole, and is not opened.
        spark.createDataFrame(lines, _LINES).coalesce(1).write.parquet(f"{folder}/layout")
        return cls.open(spark, folder)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> PreparedAuthorities:
        """Open prepared snapshots, in this or another session."""
        tables = {}
        for line in spark.read.schema(_LINES).parquet(f"{folder}/layout").collect():
            path = f"{folder}/{line['name']}"
            if line["buckets"] == 0:
                tables[line["name"]] = spark.read.schema(line["columns"]).parquet(path)
                continue
            table = _table(folder, line["name"])
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} ({line['columns']}) USING parquet "
                f"CLUSTERED BY ({line['key']}) SORTED BY ({line['key']}) "
                f"INTO {line['buckets']} BUCKETS LOCATION '{path}'"
            )
            tables[line["name"]] = spark.table(table)
        return cls(**tables)


def _table(folder: str, name: str) -> str:
    """A table name of the session's catalog that no other folder has."""
    return f"nomenlink_{hashlib.sha256(folder.encode()).hexdigest()[:24]}_{name}"


def _check_key(taxa: DataFrame) -> None:
    per_id = taxa.groupBy("aphia_id").agg(F.count(F.lit(1)).alias("n"))
    broken = per_id.where((F.col("n") > 1) | F.col("aphia_id").isNull()).limit(5).collect()
    if broken:
        ids = ", ".join(str(r["aphia_id"]) for r in broken)
        raise ValueError(f"worms_taxa has no or several records for aphia_id {ids}")


def _is_hot(rows: DataFrame, key: str, buckets: int) -> bool:
    """Whether some key has more than its share of the rows, of which there are enough."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    found = counts.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    # A key of few rows is no burden, whatever its share.
    return bool(found["most"]) and found["most"] > max(10_000, HOT_BUCKETS * found["all"] / buckets)
