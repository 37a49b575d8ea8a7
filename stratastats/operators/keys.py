"""Reports on keys before a join or a sum relies on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .exactsum import exact_sums


def key_report(df: DataFrame, key: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """``key, row_count, attribute, least, most``: what a join on ``key`` would multiply or mix.

    A key of more than one row gives a row with a null ``attribute``, and one for each attribute
    whose smallest and largest value (as text) differ; nulls differ from nothing. Null keys,
    which never join, are left out. Distinct combinations are hashed out before any is sorted.
    """
    key = list(key)
    texts = [F.col(a).cast("string").alias(f"_a{i}") for i, a in enumerate(attributes)]
    names = [f"_a{i}" for i in range(len(attributes))]
    found = (
        df.dropna(subset=key).select(*key, *texts)
        .groupBy(*key, *names).agg(F.count("*").alias("_n"))
        .groupBy(*key)
        .agg(
            F.sum("_n").alias("row_count"),
            *[f(a).alias(f"{a}_{side}") for a in names for side, f in (("lo", F.min), ("hi", F.max))],
        )
        .where("row_count > 1")
    )
    none = F.lit(None).cast("string")
    rows = [F.struct(none.alias("attribute"), none.alias("least"), none.alias("most"))]
    for attribute, a in zip(attributes, names):
        row = F.struct(
            F.lit(attribute).alias("attribute"), F.col(f"{a}_lo").alias("least"),
            F.col(f"{a}_hi").alias("most"),
        )
        rows.append(F.when(F.col(f"{a}_lo") != F.col(f"{a}_hi"), row))
    return found.select(*key, "row_count", F.inline(F.array_compact(F.array(*rows))))


def total_rows(df: DataFrame, parent: Sequence[str], value: str) -> DataFrame:
    """The rows whose value is the sum of all other values of their parent, of at least two.

    Such a row is a total that a sum would count twice. Sums are exact, so the order of rows
    decides nothing; null and NaN are no values, null parents are left out, and so are parents
    whose values are all 0.
    """
    parent = list(parent)
    rows = df.dropna(subset=parent)
    sums = exact_sums(rows, parent, {"_sum": F.col(value), "_count": F.col(value) * 0 + 1, "_size": F.abs(value)})
    return (
        rows.join(sums, parent)
        .where((F.col("_count") > 2) & (F.col("_size") > 0) & (F.col(value) * 2 == F.col("_sum")))
        .select(*df.columns)
    )
