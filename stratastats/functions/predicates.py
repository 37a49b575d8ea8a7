"""Row predicates with the null rules of the analysis.

"Not equal" and "not in" keep rows whose value is null; SQL's ``<>`` and
``NOT IN`` would drop them.
"""

from __future__ import annotations

import datetime as dt
import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .columns import ColumnLike, as_column


def within_year(c: ColumnLike, year: int) -> Column:
    """Half-open date range, which reaches the Parquet scan; ``year(c) = y`` does not."""
    c = as_column(c)
    return (c >= F.lit(dt.date(year, 1, 1))) & (c < F.lit(dt.date(year + 1, 1, 1)))


def not_equal(c: ColumnLike, value) -> Column:
    return ~as_column(c).eqNullSafe(F.lit(value))


def in_list(c: ColumnLike, values: Sequence) -> Column:
    return as_column(c).isin(list(values))


def not_in(c: ColumnLike, values: Sequence) -> Column:
    return ~F.coalesce(in_list(c, values), F.lit(False))


def contains_any(c: ColumnLike, needles: Sequence[str]) -> Column:
    """True where the text holds any of the literal, case-sensitive needles."""
    if not needles:
        return F.lit(False)
    c = as_column(c)
    return functools.reduce(operator.or_, [c.contains(F.lit(n)) for n in needles])
