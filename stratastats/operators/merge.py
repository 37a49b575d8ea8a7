"""Joining facts, attributes and prices. Null keys never match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..levels import parse_level


def inner_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, take: Sequence[str]
) -> DataFrame:
    """Left columns plus ``take`` from the right; Spark picks the join by size at run time."""
    clash = set(map(str.lower, take)) & set(map(str.lower, left.columns))
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    slim = right.select(F.col(right_key).alias("_key"), *take)
    return left.join(slim, left[left_key] == slim["_key"], "inner").drop("_key")


def merge_sources(
    facts: DataFrame,
    attributes: DataFrame,
    prices: DataFrame,
    level: str,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Three-way merge of cleaned frames in canonical columns.

    Parent level: attributes by parent id, prices by parent code. Child level:
    attributes by child id, prices by region label. A class column of the facts is
    kept when it is there.
    """
    if parse_level(level) == "parent":
        merged = inner_join(
            facts, attributes, "parent_id", "attr_parent_id", ["attr_code", "weight", "income", "rate"]
        )
        merged = inner_join(merged, prices, "attr_code", "price_code", ["price", "parent_name"])
        columns = ["parent_code", "parent_id", "amount", "weight", "income", "rate", "price",
                   "parent_name"]
    else:
        merged = inner_join(
            facts, attributes, "child_id", "attr_child_id",
            ["stratum_code", "weight", "income", "rate"],
        )
        merged = inner_join(merged, prices, "region_label", "price_label", ["price"])
        columns = ["parent_code", "parent_id", "child_part_id", "child_name", "stratum_code",
                   "amount", "weight", "income", "rate", "price", "child_id"]
    if "major_class" in facts.columns:
        columns.append("major_class")
    return merged.select(*columns, *keep)


def merge_coverage(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows and keys of each side with and without a partner on the other side.

    Counts per key are added up before the shuffle, so no join runs and a key that
    fills a third of the rows costs nothing extra. Null keys count as unmatched.
    """
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    sides = left.select(F.col(left_key).cast("string").alias("k"), one.alias("l"), zero.alias("r"))
    sides = sides.unionByName(
        right.select(F.col(right_key).cast("string").alias("k"), zero.alias("l"), one.alias("r"))
    )
    keys = sides.groupBy("k").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    hit = F.col("k").isNotNull() & (F.col("l") > 0) & (F.col("r") > 0)

    def side(name: str, c: str):
        here = F.col(c) > 0
        return F.struct(
            F.lit(name).alias("side"),
            F.count_if(here & F.col("k").isNotNull()).alias("keys"),
            F.count_if(here & hit).alias("matched_keys"),
            F.coalesce(F.sum(c), zero).alias("rows"),
            F.coalesce(F.sum(F.when(hit, F.col(c))), zero).alias("matched_rows"),
        )

    return keys.agg(F.array(side("left", "l"), side("right", "r")).alias("s")).select(
        F.inline("s")
    )
