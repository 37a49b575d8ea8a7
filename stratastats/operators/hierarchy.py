"""Rolling detailed categories and places up a hierarchy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame

from ..functions import first_token, map_or_self
from .aggregates import group_sum


def major_class(path: str, mapping: Mapping[str, str] | None = None, sep: str = " - ") -> Column:
    """First token of a category path, renamed where the mapping says so."""
    return map_or_self(first_token(path, sep), mapping or {})


def category_dictionary(
    df: DataFrame, path: str, mapping: Mapping[str, str] | None = None, sep: str = " - "
) -> DataFrame:
    """Distinct ``(major, minor)`` pairs."""
    minors = df.select(df[path].alias("minor")).where("minor is not null").distinct()
    return minors.select(major_class("minor", mapping, sep).alias("major"), "minor")


def roll_up(
    df: DataFrame,
    by: Sequence[str],
    path: str,
    amount: str,
    mapping: Mapping[str, str] | None = None,
    carry: Sequence[str] = (),
    out: str = "major_class",
    sep: str = " - ",
    exact: bool | int = False,
) -> DataFrame:
    """Sum detailed categories per place and major class; ``exact`` as in ``group_sum``."""
    classed = df.withColumn(out, major_class(path, mapping, sep))
    return group_sum(classed, [*by, out], amount, carry, cluster=by, exact=exact)
