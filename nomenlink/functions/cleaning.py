"""Cleaning of scientific and common names, as column expressions.

A cleaning chain is staged with ``withColumn`` wherever a value is read more than
once. Catalyst then keeps separate projections inside one code-generated stage and
evaluates each regular expression once per row; a single nested expression would
copy the chain at every reuse.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules


def trim(x: Column) -> Column:
    """Strip spaces, tabs and line ends; ``F.trim`` alone strips spaces only."""
    return F.btrim(x, F.lit(rules.TRIMMED))


def collapse_spaces(x: Column) -> Column:
    return F.regexp_replace(x, " {2,}", " ")


def canonical(x: Column) -> Column:
    """The form in which authority names and cleaned names are compared."""
    return F.upper(trim(x))


def token_count(x: Column) -> Column:
    return F.size(F.split(x, " "))


def remove(x: Column, pattern: str) -> Column:
    """Delete every match, then collapse spaces and trim. Reads ``x`` once."""
    return trim(collapse_spaces(F.regexp_replace(x, pattern, "")))


def invert_comma(x: Column) -> Column:
    """``SHARK, GREENLAND`` becomes ``GREENLAND SHARK``.

    The text after the last comma goes before the text ahead of the first one, and
    anything between two commas is lost. One pattern reads ``x`` once.
    """
    return trim(F.regexp_replace(x, r"(?s)^([^,]*),(?:.*,)?([^,]*)\z", "$2 $1"))


def without_scientific(sci: Column, comm: Column) -> Column:
    """Delete a literal occurrence of the scientific name from the common name."""
    return F.when(F.contains(comm, sci), F.replace(comm, sci, F.lit(""))).otherwise(comm)


def strip_redundant(
    df: DataFrame, sci_col: str, comm_col: str, output: str | None = None
) -> DataFrame:
    """Add the common name less the row's own scientific name.

    A null scientific name leaves the common name as it is, and the search text is
    never read as a pattern.
    """
    return df.withColumn(
        output or comm_col, without_scientific(F.col(sci_col), F.col(comm_col))
    )


def clean_names(
    df: DataFrame,
    col: str,
    kind: str = "scientific",
    extra_filters: Sequence[str] = (),
    output: str | None = None,
) -> DataFrame:
    """Add the cleaned form of a name column, null where nothing usable is left.

    Clean once, from the raw text: cleaning a cleaned name again can change it.
    """
    if kind not in rules.KINDS:
        raise ValueError(f"kind must be one of {rules.KINDS}, not {kind!r}")
    out = output or f"{col}_clean"
    extra = check_filters(df.sparkSession, extra_filters)
    x = F.col(out)

    # Upper-case, then null the fields no search should be made for.
    df = df.withColumn(out, F.upper(F.col(col).cast("string")))
    df = df.withColumn(out, F.when(~x.rlike(rules.drops(kind)), x))

    # A name matches few of the removal rules. Only those touch it: a rule is tried if
    # its trigger text occurs, or without one if its pattern does.
    df = df.withColumn(out, trim(collapse_spaces(x)))
    for pattern in rules.removals(kind, extra):
        trigger = rules.TRIGGERS.get(pattern) if pattern not in extra else None
        applies = x.rlike(pattern) if trigger is None else x.contains(trigger)
        df = df.withColumn(out, F.when(applies, remove(x, pattern)).otherwise(x))

    if kind == "common":
        df = df.withColumn(out, F.when(x.contains(","), invert_comma(x)).otherwise(x))
    usable = F.when(F.char_length(x) >= rules.MIN_LENGTH, x)
    return _once(df.select(*(c for c in df.columns if c != out), usable.alias(out)), out)


def _once(df: DataFrame, col: str) -> DataFrame:
    """Keep later filters from repeating the expression that makes the column.

    A filter moves below the projection it reads, and takes a copy of every expression
    along. It does not move below a generator, here of exactly one row per row.
    """
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.explode(F.array(F.col(col))).alias(col))


def check_filters(spark: SparkSession, filters: Sequence[str]) -> tuple[str, ...]:
    """Fail at the call, not in a task, when a caller's pattern does not compile."""
    if isinstance(filters, str):
        raise ValueError("filters must be a sequence of patterns, not one string")
    checked = tuple(filters or ())
    for pattern in checked:
        # Over a literal row the pattern is compiled while planning, without a Spark job.
        tried = "SELECT regexp_replace(x, :pattern, '') FROM VALUES ('x') AS t(x)"
        try:
            spark.sql(tried, args={"pattern": pattern}).collect()
        except PySparkException as error:
            if error.getCondition() != "INVALID_PARAMETER_VALUE.PATTERN":
                raise
            raise ValueError(f"not a valid pattern: {pattern!r}") from error
    return checked


def eligible(sci: Column, comm: Column) -> Column:
    """At least one cleaned name is left to search with."""
    return sci.isNotNull() | comm.isNotNull()


def review_suggestion(sugg: Column, sci: Column, comm: Column) -> Column:
    """Null a suggested spelling that only repeats one of the row's cleaned names."""
    as_sci = trim(F.regexp_replace(sugg, rules.SCIENTIFIC_MARKER, ""))
    as_comm = trim(F.regexp_replace(sugg, rules.COMMON_MARKER, ""))
    repeats = F.coalesce(as_sci == sci, F.lit(False)) | F.coalesce(
        as_comm == comm, F.lit(False)
    )
    return F.when(~repeats, sugg)
