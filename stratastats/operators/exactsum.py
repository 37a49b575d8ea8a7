"""Sums of doubles that do not depend on the order of rows or tasks.

A double is cut into four whole digits to the base 2**24, counted from its own leading place.
Digits of one place add up exactly as integers, in any order; the places are put together once,
when all rows are in. Sums and means of the same rows are therefore equal to the last bit
however the rows are dealt, and much closer to the true sum than adding doubles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import Terms, nan_as_null

BASE_BITS = 24  # digits of half a million million rows fit a 64-bit sum
DIGITS = 4  # 53 bits that begin anywhere in the first digit
LOWEST = -42  # place of the smallest normal numbers; 2**(24 * LOWEST) is still normal

_SUMS = [f"_d{i}" for i in range(DIGITS)]
PARTS = [*_SUMS, "_n", "_odd"]


def digit_sums(
    df: DataFrame, by: Sequence[str], values: Sequence[Column], least: Sequence[str] = ()
) -> DataFrame:
    """Per group, slot and place: the added digits of each of ``values``, and the ``least`` columns'
    smallest values.

    Added up before the shuffle; a group has a row per place of its values, seldom more than five.
    """
    keys = list(by)
    cells = [F.struct(F.lit(i).alias("_slot"), nan_as_null(v).alias("_x")) for i, v in enumerate(values)]
    finite = (F.abs("_x") < float("inf")) & (F.col("_x") != 0)
    place = F.greatest(F.floor(F.log2(F.abs("_x")) / BASE_BITS), F.lit(LOWEST)).cast("int")
    # In two steps, since the square may overflow
    half = F.pow(F.lit(2.0), F.col("_place") * (-BASE_BITS // 2))
    # Each step a column of its own: nested, they would multiply
    rows = (
        df.select(*keys, *least, F.inline(F.array(*cells)))
        .withColumn("_place", F.when(finite, place).otherwise(0))
        .withColumn("_half", half)
        .withColumn("_rest", F.when(finite, F.col("_x") * F.col("_half") * F.col("_half")).otherwise(0.0))
    )
    for name in _SUMS:
        rows = rows.withColumn(name, F.col("_rest").cast("bigint")).withColumn(
            "_rest", (F.col("_rest") - F.col(name)) * float(1 << BASE_BITS)
        )
    return rows.groupBy(*keys, "_slot", "_place").agg(
        *[F.sum(name).alias(name) for name in _SUMS],
        F.count("_x").alias("_n"),
        F.sum(F.when(F.abs("_x") == float("inf"), F.col("_x"))).alias("_odd"),
        *[F.min(c).alias(c) for c in least],
    )


def added(digits: DataFrame, by: Sequence[str], *others: Column) -> DataFrame:
    """Digit sums of larger groups, from those of smaller ones."""
    return digits.groupBy(*by, "_slot", "_place").agg(*[F.sum(c).alias(c) for c in PARTS], *others)


def combined(
    digits: DataFrame, by: Sequence[str], names: Sequence[str], others: Sequence[Column] = ()
) -> DataFrame:
    """``by``, one double per slot under its name (null without values), and other aggregates."""
    parts = F.struct("_place", *PARTS)
    found = digits.groupBy(*by).agg(
        *[
            F.sort_array(F.collect_list(F.when(F.col("_slot") == i, parts))).alias(name)
            for i, name in enumerate(names)
        ],
        *others,
    )
    return found.withColumns({name: _total(F.col(name)) for name in names})


def _total(parts: Column) -> Column:
    """The sum of the places in a fixed order, each step's rounding error kept beside it."""

    def add(acc: Column, x: Column) -> Column:
        total = acc["s"] + x
        lost = F.when(F.abs(acc["s"]) >= F.abs(x), (acc["s"] - total) + x).otherwise(
            (x - total) + acc["s"]
        )
        return F.struct(total.alias("s"), (acc["c"] + lost).alias("c"))

    def term(part: Column, i: int) -> Column:
        half = F.pow(F.lit(2.0), ((part["_place"] - i) * BASE_BITS).cast("double") / 2)
        return part[_SUMS[i]].cast("double") * half * half

    terms = F.flatten(
        F.transform(parts, lambda part: F.array(*[term(part, i) for i in range(DIGITS)]))
    )
    zero = F.lit(0.0)
    finite = F.aggregate(
        terms, F.struct(zero.alias("s"), zero.alias("c")), add, lambda acc: acc["s"] + acc["c"]
    )
    rows = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a + p["_n"])
    odd = F.filter(parts, lambda p: p["_odd"].isNotNull())
    infinite = F.aggregate(odd, zero, lambda a, p: a + p["_odd"])
    return F.when(rows > 0, F.when(F.size(odd) > 0, infinite).otherwise(finite))


def exact_sums(df: DataFrame, by: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """``by`` and the sum of each column as a double; null for a group without values.

    One row without ``by``. Null and NaN are left out; infinite values give what adding them gives.
    """
    names = list(sums)
    return combined(digit_sums(df, by, list(sums.values())), by, names).select(*by, *names)


def weighted_means(df: DataFrame, by: Sequence[str], means: Mapping[str, Terms]) -> DataFrame:
    """``by`` and a ratio of exact sums for each of ``means``; null where the weights add to 0."""
    sums = {f"_{side}_{out}": getattr(t, side) for out, t in means.items() for side in ("num", "den")}
    found = exact_sums(df, by, sums)
    return found.select(
        *by, *[F.try_divide(F.col(f"_num_{out}"), F.col(f"_den_{out}")).alias(out) for out in means]
    )
