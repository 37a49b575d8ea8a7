"""Arithmetic on measures. Division by zero gives null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import ColumnLike, as_column


def nan_as_null(c: ColumnLike) -> Column:
    """Double with NaN turned to null and negative zero to zero.

    Spark would sort NaN above every number and rank -0.0 below 0.0.
    """
    c = as_column(c).cast("double")
    return F.when(~F.isnan(c), c + F.lit(0.0))


def rate_per_weight(amount: ColumnLike, weight: ColumnLike, scale: float = 2000.0) -> Column:
    return F.try_divide(as_column(amount).cast("double"), as_column(weight).cast("double")) * F.lit(
        float(scale)
    )


def ratio(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    return F.try_divide(as_column(numerator), as_column(denominator))


def scale_units(c: ColumnLike, divisor: float | Column) -> Column:
    divisor = divisor if isinstance(divisor, Column) else F.lit(float(divisor))
    return as_column(c) / divisor


def minmax(c: ColumnLike, lo: Column, hi: Column) -> Column:
    return F.try_divide(as_column(c) - lo, hi - lo)


def round_significant(c: ColumnLike, digits: int = 6) -> Column:
    """Round half-even to a number of significant digits; zero stays zero.

    Scaling divides by a positive power of ten for large values, since a negative
    power is not exact in binary.
    """
    c = as_column(c).cast("double")
    magnitude = F.floor(F.log10(F.abs(c)))
    places = F.lit(digits - 1) - magnitude
    up = F.pow(F.lit(10.0), F.greatest(places, F.lit(0)))
    down = F.pow(F.lit(10.0), F.greatest(-places, F.lit(0)))
    return (
        F.when(c == 0, F.lit(0.0))
        .when(places >= 0, F.bround(c * up, 0) / up)
        .otherwise(F.bround(c / down, 0) * down)
    )


def round_trunc_int(c: ColumnLike, places: int = 3) -> Column:
    """Round half-even, then cut the fraction; NaN is missing."""
    c = as_column(c)
    return F.bround(F.when(~F.isnan(c), c), places).cast("bigint")
