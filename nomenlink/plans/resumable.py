"""A resolution that goes on where an earlier, unfinished one ended."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame

from ..operators.assemble import Resolved
from ..sources.authorities import Authorities
from ..sources.runs import Run
from .resolve import resolve_names


def resolve_resumably(
    names: DataFrame, authorities: Authorities, folder: str, **options
) -> tuple[Resolved, Run]:
    """As ``resolve_names`` with these options, and the run whose steps are in ``folder``.

    Called again with equal inputs and options, also by another session, it takes the steps
    that are whole and goes on after them. Inputs count as equal if they have the same
    columns and rows, in any order; each is read once more to see that. The results read
    the run's folder: write them elsewhere before ``run.remove()``.
    """
    inputs = {f.name: getattr(authorities, f.name) for f in fields(Authorities)}
    inputs |= {"names": names} | {k: v for k, v in options.items() if isinstance(v, DataFrame)}
    inputs = {k: v for k, v in inputs.items() if v is not None}
    plain = {k: v for k, v in options.items() if not isinstance(v, DataFrame)}
    run = Run(names.sparkSession, folder, inputs, plain)
    with run.steps():
        return resolve_names(names, authorities, **options), run
