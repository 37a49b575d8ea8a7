"""Registered queries over the supplied tables, each with its SQL twin where one exists."""

from .registry import ORACLE, QUERIES

from . import (  # noqa: E402,F401  (each module registers its queries)
    cleaning,
    correlation,
    distributions,
    filters,
    merging,
    profiling,
    scalars,
    strata,
    summaries,
)

__all__ = ["ORACLE", "QUERIES"]
