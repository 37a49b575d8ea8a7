"""Cleaning the three inputs to canonical columns, at parent or child level."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import (
    cast_string,
    concat_ids,
    contains_any,
    id_prefix,
    nan_as_null,
    not_equal,
    not_in,
    region_label,
    round_significant,
    weighted_terms,
    within_year,
    zero_pad,
)
from ..levels import parse_level
from ..operators.aggregates import carry_first, group_sum
from ..operators.exactsum import combined, digit_sums
from ..operators.hierarchy import roll_up
from ..operators.quantiles import TASK_ROWS, grouped_median
from . import presets


def clean_prices(
    df: DataFrame,
    level: str,
    year: int = presets.YEAR,
    equals: Mapping[str, str] = presets.PRICE_EQUALS,
    excluded_parent: str = presets.PRICE_EXCLUDED_PARENT,
    digits: int = presets.SIGNIFICANT_DIGITS,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Median price per place in one year, rounded to significant digits.

    In: ``period_begin, parent_name, parent_code, region_label, price`` and the
    columns of ``equals``. Out at parent level: ``parent_name, price_code, price``;
    at child level ``price_label`` and ``parent_name, price_code`` besides.
    """
    level = parse_level(level)
    by = ["parent_name"] if level == "parent" else ["region_label"]
    rows = df.where(within_year("period_begin", year))
    for column, value in equals.items():
        rows = rows.where(F.col(column) == value)
    rows = rows.withColumn("price", nan_as_null("price")).dropna(subset=["price"])
    rows = rows.where(not_equal("parent_name", excluded_parent)).dropna(subset=by)

    carry = {"price_code": "parent_code"}
    if level == "child":
        carry["parent_name"] = "parent_name"
    median = grouped_median(rows, by, "price", "price", task_rows, carry)
    median = median.withColumn("price", round_significant("price", digits))
    return median.withColumnsRenamed({"region_label": "price_label"})


def clean_attributes(
    df: DataFrame,
    level: str,
    excluded_codes: Sequence[str] = presets.ATTRIBUTE_EXCLUDED_CODES,
    id_width: int = presets.ID_WIDTH,
    parent_width: int = presets.PARENT_ID_WIDTH,
    drop_parent_totals: Column | None = None,
) -> DataFrame:
    """Weight, income and rate per place.

    In: ``area_id`` (number or text), ``area_name, parent_code, weight, income, rate,
    stratum_code``. The parent level sums the weight and takes weighted means.
    ``drop_parent_totals`` is a predicate for rows that already are parent totals;
    by default they stay, as in the analysis this follows.
    """
    level = parse_level(level)
    child_id = zero_pad(cast_string("area_id", dict(df.dtypes)["area_id"] != "string"), id_width)
    rows = df.select(
        "area_id",
        "area_name",
        F.col("parent_code").alias("attr_code"),
        *[nan_as_null(c).alias(c) for c in ("weight", "income", "rate")],
        "stratum_code",
    ).dropna(subset=["weight", "income", "rate"])
    rows = rows.where(not_in("attr_code", excluded_codes))
    if drop_parent_totals is not None:
        rows = rows.where(~drop_parent_totals)
    if level == "parent":
        # The smallest id stands for its parent; as a number it needs no sort to find.
        income, rate = weighted_terms("income", "weight"), weighted_terms("rate", "weight")
        digits = digit_sums(
            rows.dropna(subset=["attr_code"]), ["attr_code"],
            [income.num, income.den, rate.num, rate.den, F.col("weight")], least=["area_id"],
        )
        names = ["_income", "_by_income", "_rate", "_by_rate", "weight"]
        rows = combined(digits, ["attr_code"], names, [carry_first("area_id")]).select(
            "attr_code",
            "area_id",
            F.try_divide("_income", "_by_income").alias("income"),
            F.try_divide("_rate", "_by_rate").alias("rate"),
            "weight",
        )
    return rows.select(
        child_id.alias("attr_child_id"),
        id_prefix(child_id, parent_width).alias("attr_parent_id"),
        *[c for c in rows.columns if c != "area_id"],
    )


def clean_facts(
    df: DataFrame,
    level: str,
    contributor: str = "residential",
    agg: bool = True,
    contributors: Mapping[str, Sequence[str]] = presets.CONTRIBUTORS,
    mapping: Mapping[str, str] | None = None,
    excluded_codes: Sequence[str] = presets.FACT_EXCLUDED_CODES,
) -> DataFrame:
    """Amounts per place, of one contributor, all of them, or by major class.

    In: ``parent_id, parent_code, child_part_id, child_name, sector_path, amount``.

    ==============  ==================  ===========================================
    contributor     ``agg=True``        ``agg=False``
    ==============  ==================  ===========================================
    by sector       one row per place   one row per place and major class
    named or all    one row per place   parent: per place and category; child: rows
    ==============  ==================  ===========================================

    Codes outside the study are dropped before the shuffle; a code depends on the
    place, so the groups are the same as when dropped afterwards.
    """
    level = parse_level(level)
    rows = df.where(not_in("parent_code", excluded_codes))
    place, carry = ["parent_id"], ["parent_code"]
    if level == "child":
        rows = rows.withColumn("child_id", concat_ids("parent_id", "child_part_id"))
        place, carry = ["child_id"], ["parent_id", "parent_code", "child_part_id", "child_name"]

    if contributor == "by sector":
        if agg:
            out = group_sum(rows.dropna(subset=["sector_path"]), place, "amount", carry)
        else:
            out = roll_up(rows, place, "sector_path", "amount", mapping, carry)
    elif contributor != "all" and contributor not in contributors:
        raise ValueError(
            f"contributor must be 'by sector', 'all' or one of {sorted(contributors)}, "
            f"got {contributor!r}"
        )
    else:
        if contributor != "all":
            rows = rows.where(contains_any("sector_path", contributors[contributor]))
        if agg:
            out = group_sum(rows, place, "amount", carry)
        elif level == "parent":
            out = group_sum(rows, ["sector_path", *place], "amount", carry)
        else:
            out = rows
    if level == "child":
        out = out.withColumn("region_label", region_label("child_name", "parent_code"))
    return out
