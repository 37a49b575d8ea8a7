"""Identifiers, labels and dates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .columns import ColumnLike, as_column


def parse_dates(df: DataFrame, columns: Iterable[str], strict: bool = True) -> DataFrame:
    """Parse text columns to zone-free timestamps; ``strict=False`` turns bad text into null."""
    parse = F.to_timestamp if strict else F.try_to_timestamp
    return df.withColumns({c: parse(F.col(c)).cast("timestamp_ntz") for c in columns})


def cast_string(c: ColumnLike, numeric: bool = False) -> Column:
    """Text form of an identifier; null stays null.

    ``numeric=True`` goes through bigint so that an id read as a double does not
    pick up a trailing ``.0``.
    """
    c = as_column(c)
    return (c.cast("bigint") if numeric else c).cast("string")


def zero_pad(c: ColumnLike, width: int) -> Column:
    """Left-pad with zeros; longer values stay whole (``lpad`` alone cuts them)."""
    c = as_column(c)
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def id_prefix(c: ColumnLike, length: int = 2) -> Column:
    return F.substring(as_column(c), 1, length)


def concat_ids(*parts: ColumnLike) -> Column:
    """Composite id; null when any part is null."""
    return F.concat(*[as_column(p).cast("string") for p in parts])


def region_label(name: ColumnLike, code: ColumnLike, infix: str = " County, ") -> Column:
    return F.concat(as_column(name), F.lit(infix), as_column(code))


def first_token(c: ColumnLike, sep: str = " - ") -> Column:
    return F.substring_index(as_column(c), sep, 1)


def map_or_self(c: ColumnLike, mapping: Mapping[str, str]) -> Column:
    """Look a value up in a small mapping; unmapped values stay as they are."""
    c = as_column(c)
    if not mapping:
        return c
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def format_label(name: ColumnLike, value: ColumnLike, unit: str | Column) -> Column:
    """``name: value unit`` with the value rounded half-even to a whole number; NaN is missing."""
    value = as_column(value)
    value = F.when(~F.isnan(value), value)
    unit = unit if isinstance(unit, Column) else F.lit(unit)
    whole = F.bround(value, 0)
    text = F.when((value < 0) & (whole == 0), F.lit("-0")).otherwise(
        whole.cast("bigint").cast("string")
    )
    return F.concat(as_column(name), F.lit(": "), text, F.lit(" "), unit)


def scientific_label(value: ColumnLike) -> Column:
    """One-decimal scientific notation, exact ties to the even digit, null for null.

    ``format_string`` rounds ties up. A tie needs two digits and a half, and such a
    double has at most ten fractional bits.
    """
    value = as_column(value)
    size = F.abs(value)
    exponent = F.floor(F.log10(size))
    digits = F.when(
        exponent > 1, size / F.pow(F.lit(10.0), exponent - 1)
    ).otherwise(size * F.pow(F.lit(10.0), 1 - exponent))
    exact = size * 1024 == F.floor(size * 1024)
    round_down = exact & (digits % 2 == 0.5)
    return F.when(
        value.isNotNull(),
        F.format_string("%.1e", F.when(round_down, value * (1 - 1e-9)).otherwise(value)),
    )
