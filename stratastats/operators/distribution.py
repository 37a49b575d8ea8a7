"""Histograms, moments and the fitted normal curve."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import nan_as_null, scale_units
from .reshape import union_all


def _extent(values: DataFrame):
    """Smallest, largest and count of ``x`` as a one-row scalar subquery.

    A constant column is widened by half a unit on both sides, so bins have a width.
    """
    flat = F.min("x") == F.max("x")
    half = F.when(flat, F.lit(0.5)).otherwise(F.lit(0.0))
    return values.agg(
        F.struct(
            (F.min("x") - half).alias("lo"), (F.max("x") + half).alias("hi"),
            F.count("x").alias("n"),
        ).alias("extent")
    ).scalar()


def _binned(df: DataFrame, slots: Sequence[tuple[str, float, int]]) -> DataFrame:
    """Histograms of several ``(column, divisor, bins)`` of a frame: two scans for all of them.

    One row per slot and bin, empty bins too: ``slot, bin, lo, hi, count, n, width``.
    """
    scaled = [scale_units(nan_as_null(c), d) if d != 1 else nan_as_null(c) for c, d, _ in slots]
    wide = df.select(*[x.alias(f"_x{i}") for i, x in enumerate(scaled)])
    extents = []
    for i, (_, _, bins) in enumerate(slots):
        x = f"_x{i}"
        half = F.when(F.min(x) == F.max(x), F.lit(0.5)).otherwise(F.lit(0.0))
        extents.append(
            F.struct(
                F.lit(i).alias("slot"), F.lit(int(bins)).alias("bins"), (F.min(x) - half).alias("lo"),
                (F.max(x) + half).alias("hi"), F.count(x).alias("n"),
            )
        )
    # One row per slot
    extent = F.broadcast(wide.agg(F.array(*extents).alias("e")).select(F.inline("e")))

    def edge(i):
        step = (F.col("hi") - F.col("lo")) / F.col("bins")
        return F.when(i == F.col("bins"), F.col("hi")).otherwise(F.col("lo") + i * step)

    cells = [F.struct(F.lit(i).alias("slot"), F.col(f"_x{i}").alias("x")) for i in range(len(slots))]
    values = wide.select(F.inline(F.array(*cells))).where("x is not null").join(extent, "slot")
    guess = F.least(
        F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")),
        F.col("bins") - 1,
    )
    # Float division can land one bin off; compare with the edges themselves.
    placed = values.withColumn("i", guess).select(
        "slot",
        (
            F.col("i")
            - F.when(F.col("x") < edge(F.col("i")), 1).otherwise(0)
            + F.when(
                (F.col("i") < F.col("bins") - 1) & (F.col("x") >= edge(F.col("i") + 1)), 1
            ).otherwise(0)
        ).alias("bin"),
    )
    counted = placed.groupBy("slot", "bin").agg(F.count("*").alias("count"))
    axis = extent.select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("bins") - 1).cast("bigint"))).alias("bin")
    )
    # ``counted`` has at most one row per bin.
    out = axis.join(F.broadcast(counted), ["slot", "bin"], "left")
    return out.select(
        "slot", F.col("bin").cast("int").alias("bin"), edge(F.col("bin")).alias("from"),
        edge(F.col("bin") + 1).alias("to"), F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        "n", ((F.col("hi") - F.col("lo")) / F.col("bins")).alias("width"),
    ).withColumnsRenamed({"from": "lo", "to": "hi"})


def histogram(
    df: DataFrame, column: str, bins: int, divisor: float = 1.0, density: bool = False
) -> DataFrame:
    """Equal-width bins over the data range: ``bin, lo, hi, count`` (and ``density``).

    Bins are left-closed, the last one closed on both sides; empty bins are listed. A constant
    column is widened by half a unit on both sides, so bins have a width.
    """
    out = _binned(df, [(column, divisor, bins)])
    share = F.try_divide(F.col("count").cast("double"), F.col("n") * F.col("width")).alias("density")
    return out.select("bin", "lo", "hi", "count", *([share] if density else []))


def histogram_panel(panels: Sequence[tuple[str, DataFrame, str, float, int]]) -> DataFrame:
    """Histograms of several ``(metric, frame, column, divisor, bins)`` in one table.

    All histograms of a frame come from the same two scans of it.
    """
    frames: dict[int, tuple[DataFrame, list, list]] = {}
    for metric, df, column, divisor, bins in panels:
        _, names, slots = frames.setdefault(id(df), (df, [], []))
        names.append(F.lit(metric))
        slots.append((column, divisor, bins))
    return union_all(
        [
            _binned(df, slots).select(
                "bin", "lo", "hi", "count", F.get(F.array(*names), F.col("slot")).alias("metric")
            )
            for df, names, slots in frames.values()
        ]
    )


def excess_kurtosis(column: str):
    """Aggregate: biased excess kurtosis, null for a constant column."""
    x = nan_as_null(column)
    return F.when(F.stddev_pop(x) > 0, F.kurtosis(x))


def normal_fit(df: DataFrame, column: str) -> DataFrame:
    """Maximum-likelihood normal fit: ``mu``, ``sigma``, with ``n`` and ``kurtosis``."""
    x = nan_as_null(column)
    return df.agg(
        F.count(x).alias("n"), F.avg(x).alias("mu"), F.stddev_pop(x).alias("sigma"),
        excess_kurtosis(column).alias("kurtosis"),
    )


def normal_curve(df: DataFrame, column: str, points: int = 100, margin: float = 0.05) -> DataFrame:
    """The fitted density on an even grid over the data range plus a margin."""
    values = df.select(nan_as_null(column).alias("x")).where("x is not null")
    extent = _extent(values)
    fit = normal_fit(values, "x").select(F.struct("mu", "sigma").alias("fit")).scalar()
    grid = df.sparkSession.range(points).select(
        F.col("id").cast("int").alias("point"), extent.alias("e"), fit.alias("f")
    )
    pad = (F.col("e.hi") - F.col("e.lo")) * F.lit(margin)
    left, right = F.col("e.lo") - pad, F.col("e.hi") + pad
    grid = grid.withColumn("x", left + (right - left) * F.col("point") / F.lit(points - 1))
    z = F.try_divide(F.col("x") - F.col("f.mu"), F.col("f.sigma"))
    density = F.try_divide(F.exp(-z * z / 2), F.col("f.sigma") * F.lit(math.sqrt(2 * math.pi)))
    return grid.select("point", "x", density.alias("density"))


def normality_report(df: DataFrame, column: str, bins: int = 50, points: int = 100) -> DataFrame:
    """Histogram, fitted curve and moments in one long table ``part, i, x, y``."""
    bars = histogram(df, column, bins, density=True).select(
        F.lit("histogram").alias("part"), F.col("bin").alias("i"), F.col("lo").alias("x"),
        F.col("density").alias("y"),
    )
    curve = normal_curve(df, column, points).select(
        F.lit("curve").alias("part"), F.col("point").alias("i"), "x", F.col("density").alias("y")
    )
    none = F.lit(None).cast("double").alias("x")
    moments = normal_fit(df, column).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("part"), F.lit(0).alias("i"), none,
                             F.col(name).alias("y"))
                    for name in ("mu", "sigma", "kurtosis")
                ]
            )
        )
    )
    return union_all([bars, curve, moments])
