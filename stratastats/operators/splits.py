"""Cutting a numeric column into value ranges of about equal row count, on two levels.

Ranks need "how many rows are smaller". The ranges give that without a sort in one task: count
per range, add the counts up, and order rows only inside their own range. The coarse cut points
are a fixed number of literals. Where one range of them holds more rows than a task should order,
every coarse range is cut again at points of its own, kept in a stored table that rows meet by
their coarse range; their number follows from the rows and has no limit. A cut point is a range
by itself, so a value that fills a quantile never shares its range. A row's range is a pure
function of its value and of stored points, so a re-run task always agrees with the first run.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import written

COARSE = 256
SAMPLE_ROWS = 1_000_000  # for the coarse points
SAMPLE_PER_RANGE = 200  # for the fine ones
BROADCAST_POINTS = 1_000_000  # 8 MB


@dataclass(frozen=True)
class Ranges:
    points: tuple[float, ...]
    fine: DataFrame | None = None  # (_coarse, _points): sorted, padded with infinity
    size: int = 1  # fine points per coarse range, a power of two less one


def find_ranges(df: DataFrame, value: str, rows: int, task_rows: int) -> Ranges:
    """Cut points near the quantiles of the non-null double ``value`` of ``rows`` rows.

    They only balance the ranges, so they come from samples: the quantile summaries of every
    task meet in one, and must stay small.
    """
    row = (
        _sample(df, SAMPLE_ROWS, rows)
        .agg(F.percentile_approx(value, [i / COARSE for i in range(1, COARSE)], 10_000).alias("q"))
        .first()
    )
    cuts = {0.0 if q == 0 else q for q in (row.q or []) if math.isfinite(q)}
    cuts |= {math.nextafter(q, math.inf) for q in cuts}
    ranges = Ranges((-math.inf, *sorted(c for c in cuts if math.isfinite(c)), math.inf))

    each = -(-rows // (COARSE * task_rows))
    if each < 2:
        return ranges
    size = 2 ** math.ceil(math.log2(each + 1)) - 1
    sample = _sample(df, SAMPLE_PER_RANGE * COARSE * (size + 1), rows)
    probes = [i / (size + 1) for i in range(1, size + 1)]
    points = F.array_distinct(F.percentile_approx(value, probes, max(1000, 10 * size)))
    padding = F.array_repeat(F.lit(math.inf), size)
    fine = with_range(sample, value, ranges, "_coarse").groupBy("_coarse").agg(
        F.slice(F.concat(points, padding), 1, size).alias("_points")
    )
    return Ranges(ranges.points, written(fine, "points"), size)


def _sample(df: DataFrame, wanted: int, rows: int) -> DataFrame:
    return df if rows <= wanted else df.sample(wanted / rows, seed=1)


def with_range(df: DataFrame, value: str, ranges: Ranges, out: str) -> DataFrame:
    """Add the number of a non-null double's range; a larger value never has a smaller number.

    Binary search on both levels, on the JVM.
    """
    if len(ranges.points) <= 2:
        coarse = df.withColumn(out, F.lit(0).cast("bigint"))
    else:
        cut = Bucketizer(
            splits=list(ranges.points), inputCol=value, outputCol=out, handleInvalid="keep"
        )
        coarse = cut.transform(df).withColumn(out, F.col(out).cast("bigint"))
    if ranges.fine is None:
        return coarse
    fine = ranges.fine
    if len(ranges.points) * ranges.size <= BROADCAST_POINTS:
        fine = F.broadcast(fine)
    # A range that the sample missed has no points and stays whole
    found = coarse.join(fine.withColumnRenamed("_coarse", out), out, "left")
    found = with_cut(found, "_points", ranges.size, value, "_cut")
    number = F.col(out) * (2 * ranges.size + 2) + F.col("_cut")
    return found.withColumn(out, number.cast("bigint")).select(*df.columns, out)


def with_cut(df: DataFrame, points: str, size: int, value: str, out: str) -> DataFrame:
    """Where ``value`` stands among the sorted array ``points`` of up to ``size`` (2**k - 1).

    Odd numbers are the points themselves, even ones what lies between. Each step of the binary
    search is a column of its own, so that no generated method grows too long to be compiled.
    """
    step, at, names = (size + 1) // 2, F.lit(0), []
    while step:
        names.append(f"_{out}{step}")
        passed = F.coalesce(F.get(points, at + (step - 1)) <= F.col(value), F.lit(False))
        df = df.withColumn(names[-1], at + F.when(passed, step).otherwise(0))
        step, at = step // 2, F.col(names[-1])
    equal = F.coalesce(F.get(points, at - 1) == F.col(value), F.lit(False))
    return df.withColumn(out, 2 * at - F.when(equal, 1).otherwise(0)).drop(*names)
