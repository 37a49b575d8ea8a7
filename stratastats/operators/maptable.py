"""Per-region tables behind a map."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import format_label, minmax, round_trunc_int, scale_units
from ..sources.scratch import written
from .reshape import without_nan


@dataclass(frozen=True)
class Metric:
    unit: str
    label: str
    divisor: float = 1.0


# Units, labels and divisors of the mapped measures.
METRICS: dict[str, Metric] = {
    "amount": Metric("TPY", "Emissions", 2000.0),
    "amount_per_person": Metric("(lbs)", "CO per Capita"),
    "weight": Metric("Workers", "Labor Force Size"),
    "income": Metric("(USD)", "Median Income"),
    "rate": Metric("(%)", "Unemployment"),
    "price": Metric("(USD)", "Property Value"),
}


def metric_metadata(column: str, metrics: Mapping[str, Metric] = METRICS) -> Metric:
    try:
        return metrics[column]
    except KeyError:
        raise ValueError(f"no metric is declared for column {column!r}") from None


def minmax_normalise(df: DataFrame, column: str, out: str, store: bool = False) -> DataFrame:
    """Scale a column to [0, 1]; null when all values are equal. NaN is missing.

    The extent is a scalar subquery over the same frame; ``store`` writes a frame that is
    expensive to compute once, before both passes.
    """
    df = without_nan(written(df, "minmax") if store else df, column)
    extent = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    return (
        df.withColumn("_extent", extent)
        .withColumn(out, minmax(column, F.col("_extent.lo"), F.col("_extent.hi")))
        .drop("_extent")
    )


def map_tables(
    df: DataFrame,
    columns: Sequence[str],
    region: str,
    normalise: bool = False,
    metrics: Mapping[str, Metric] = METRICS,
) -> DataFrame:
    """``region, metric, value, z, text, unit, title``: one row per region and column, one scan.

    For ``normalise`` the columns are written once and read for their extents and the rows.
    """
    chosen = {c: metric_metadata(c, metrics) for c in columns}
    wide = without_nan(
        df.select(F.col(region).alias("region"), *[F.col(c).cast("double").alias(c) for c in columns]),
        *columns,
    )
    extents: dict[str, Column] = {}
    if normalise:
        wide = written(wide, "maps")
        extent = wide.agg(
            F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns]).alias("e")
        ).scalar()
        wide = wide.withColumn("_extents", extent)
        extents = {c: F.col("_extents")[c] for c in columns}
    cells = []
    for c, metric in chosen.items():
        value = F.col(c)
        if normalise:
            value = minmax(c, extents[c]["lo"], extents[c]["hi"])
        elif metric.divisor != 1:
            value = scale_units(c, metric.divisor)
        cells.append(
            F.struct(
                F.lit(c).alias("metric"), value.alias("value"), F.lit(metric.unit).alias("unit"),
                F.lit(f"{metric.label} {metric.unit}").alias("title"),
            )
        )
    return wide.select("region", F.inline(F.array(*cells))).select(
        "region",
        "metric",
        "value",
        round_trunc_int("value").alias("z"),
        format_label("region", "value", F.col("unit")).alias("text"),
        "unit",
        "title",
    )


def map_table(
    df: DataFrame,
    column: str,
    region: str,
    normalise: bool = False,
    metrics: Mapping[str, Metric] = METRICS,
) -> DataFrame:
    """``region, value, z, text, unit, title`` with one row per region."""
    return map_tables(df, [column], region, normalise, metrics).drop("metric")
