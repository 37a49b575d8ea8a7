"""Largest and smallest rows. Ties are broken by key; missing values (null, NaN) come last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import nan_as_null, scale_units, scientific_label
from .reshape import union_all, without_nan


def top_n(df: DataFrame, column: str, key: Sequence[str], n: int = 5) -> DataFrame:
    return without_nan(df, column).orderBy(F.col(column).desc_nulls_last(), *key).limit(n)


def bottom_n(df: DataFrame, column: str, key: Sequence[str], n: int = 5) -> DataFrame:
    return without_nan(df, column).orderBy(F.col(column).asc_nulls_last(), *key).limit(n)


def extremes(df: DataFrame, column: str, key: Sequence[str], n: int = 5) -> DataFrame:
    """Top ``n`` and bottom ``n`` with ``side`` and ``rank_no``.

    A row of a short frame can be in both halves. Numbering runs over ``n`` rows.
    """
    halves = {
        "top": (top_n(df, column, key, n), F.col(column).desc_nulls_last()),
        "bottom": (bottom_n(df, column, key, n), F.col(column).asc_nulls_last()),
    }
    return union_all(
        [
            half.withColumn("side", F.lit(side)).withColumn(
                "rank_no", F.row_number().over(Window.partitionBy("side").orderBy(order, *key))
            )
            for side, (half, order) in halves.items()
        ]
    )


def measure_extremes(
    df: DataFrame, cells: Sequence[Column], key: Sequence[str], n: int = 5
) -> DataFrame:
    """Extremes of many measures of a frame in one scan of it.

    ``cells`` are structs with ``metric`` (its name), ``value`` and what else a measure carries;
    their fields join the columns of ``df``, with ``side`` and ``rank_no``. Values are compared
    as doubles. Every task keeps ``n`` rows per measure and side before anything is shuffled.
    """
    sided = df.select("*", F.inline(F.array(*cells))).select(
        "*", F.explode(F.array(F.lit("top"), F.lit("bottom"))).alias("side")
    )
    value = nan_as_null("value")
    order = F.when(F.col("side") == "top", -value).otherwise(value)
    place = Window.partitionBy("metric", "side").orderBy(order.asc_nulls_last(), *key)
    return sided.withColumn("rank_no", F.row_number().over(place)).where(F.col("rank_no") <= n)


def extremes_panel(
    panels: Sequence[tuple[str, DataFrame, str, float, str]],
    key: Sequence[str],
    secondary: str | None = None,
    secondary_divisor: float = 100_000.0,
    n: int = 5,
) -> DataFrame:
    """Extremes of several ``(metric, frame, column, divisor, location column)``.

    Gives metric, side, rank_no, location, the scaled value and its short label,
    and a second measure (scaled) where ``secondary`` names one. A frame that several
    metrics name is read once.
    """
    frames: dict[int, tuple[DataFrame, list[Column]]] = {}
    for metric, df, column, divisor, location in panels:
        cell = F.struct(
            F.lit(metric).alias("metric"), nan_as_null(column).alias("value"),
            F.lit(float(divisor)).alias("_divisor"), F.col(location).cast("string").alias("location"),
        )
        frames.setdefault(id(df), (df, []))[1].append(cell)
    parts = []
    for df, cells in frames.values():
        kept = df.select(
            *[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)],
            *([F.col(secondary).cast("double").alias("_second")] if secondary else []),
            F.array(*cells).alias("_cells"),
        )
        found = measure_extremes(
            kept, [F.get("_cells", F.lit(i)) for i in range(len(cells))],
            [f"_key{i}" for i in range(len(key))], n,
        )
        scaled = scale_units("value", F.col("_divisor"))
        parts.append(
            found.select(
                "metric", "side", "rank_no", "location", scaled.alias("value"),
                scientific_label(scaled).alias("label"),
                *([scale_units("_second", secondary_divisor).alias("secondary")] if secondary else []),
            )
        )
    return union_all(parts)
