"""The four questions: ratios, correlation, class drift, bucketed drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import amount_terms, bucket_label, decode, rate_per_weight, ratio
from ..operators.correlation import spearman
from ..operators.extremes import measure_extremes
from ..operators.strata import nominal_drift, sort_custom_order
from . import presets


def with_ratios(merged: DataFrame, scale: float = presets.POUNDS_PER_TON) -> DataFrame:
    """Add the amount per person and its ratios to income and to price."""
    return merged.withColumn(
        "amount_per_person", rate_per_weight("amount", "weight", scale)
    ).withColumns(
        {
            "income_ratio": ratio("amount_per_person", "income"),
            "price_ratio": ratio("amount_per_person", "price"),
        }
    )


def ratio_extremes(
    merged: DataFrame, key: Sequence[str], n: int = 5,
    ratios: Sequence[str] = ("income_ratio", "price_ratio"),
) -> DataFrame:
    """Places with the largest and the smallest ratios, one block per ratio; one scan."""
    cells = [F.struct(F.lit(r).alias("metric"), F.col(r).alias("value")) for r in ratios]
    found = measure_extremes(with_ratios(merged), cells, key, n)
    return found.withColumnRenamed("value", "ratio")


def correlation_lines(
    rated: DataFrame, key: Sequence[str], stratum: str = "stratum_code",
    labels: Mapping | None = None,
) -> DataFrame:
    """Per stratum: correlation of the amount per person with income and with price."""
    pairs = [("amount_per_person", "income"), ("amount_per_person", "price")]
    long = spearman(rated, ["amount_per_person", "income", "price"], key, [stratum], pairs)
    lines = long.groupBy(stratum).agg(
        F.max(F.when(F.col("b") == "income", F.col("rho"))).alias("rho_income"),
        F.max(F.when(F.col("b") == "price", F.col("rho"))).alias("rho_price"),
    )
    if labels:
        lines = lines.withColumn("label", decode(stratum, labels))
    return lines


def class_drift(
    merged: DataFrame, stratum: str = "stratum_code", cls: str = "major_class",
    excluded: str | None = presets.EXCLUDED_CLASS, sign: int = 1,
) -> DataFrame:
    """Drift of the class mix per stratum, weighting the per-person amount by people."""
    return nominal_drift(merged, stratum, cls, amount_terms("amount", "weight"), excluded, sign)


def bucket_drift(
    merged: DataFrame, column: str = "income", cls: str = "major_class",
    edges: Sequence[float] = presets.INCOME_EDGES, labels: Sequence[str] = presets.INCOME_LABELS,
    excluded: str | None = presets.EXCLUDED_CLASS,
) -> DataFrame:
    """Drift of the class mix per income bucket, in the order of the labels."""
    bucketed = merged.withColumn("bucket", bucket_label(column, edges, labels))
    drift = class_drift(bucketed, "bucket", cls, excluded)
    return sort_custom_order(drift, "bucket", labels, cls)
