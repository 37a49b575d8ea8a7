"""Weighted means as plain aggregate expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .columns import ColumnLike, as_column


def present(c: Column) -> Column:
    """Neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


@dataclass(frozen=True)
class Terms:
    """Row-level numerator and denominator of a ratio of sums."""

    num: Column
    den: Column

    def mean(self) -> Column:
        return F.try_divide(F.sum(self.num).cast("double"), F.sum(self.den).cast("double"))


def weighted_terms(value: ColumnLike, weight: ColumnLike) -> Terms:
    """Terms of the weighted mean of ``value``; a missing value or weight is left out."""
    value, weight = as_column(value), as_column(weight)
    usable = present(value) & present(weight)
    return Terms(F.when(usable, value * weight), F.when(usable, weight))


def amount_terms(amount: ColumnLike, weight: ColumnLike) -> Terms:
    """Terms of the weighted mean of ``amount / weight``.

    The weight cancels (sum((a/w)*w) = sum(a)), so the rate is never materialised.
    """
    amount, weight = as_column(amount), as_column(weight)
    usable = present(amount) & present(weight) & (weight != 0)
    return Terms(F.when(usable, amount), F.when(usable, weight))


def weighted_avg(value: ColumnLike, weight: ColumnLike) -> Column:
    """Aggregate: weighted mean, null when the weights sum to zero."""
    return weighted_terms(value, weight).mean()
