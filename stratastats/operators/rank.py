"""Average (fractional) ranks: ties share the mean of their places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import nan_as_null
from ..sources.scratch import written
from .splits import find_ranges, with_range

BROADCAST_ROWS = 200_000
TASK_ROWS = 1_000_000  # rows that a task puts in order


def average_rank(
    df: DataFrame,
    value: str,
    key: Sequence[str],
    by: Sequence[str] = (),
    out: str = "avg_rank",
    task_rows: int = TASK_ROWS,
    keep_nulls: bool = True,
    rows: int | None = None,
) -> DataFrame:
    """Rank ``value`` within each ``by`` group (or over everything); nulls get no rank.

    Rows are shuffled once, by (group, value range), whatever the size of a group. Ranges hold
    about ``task_rows`` rows; of one that holds more and only a single value, found by its count
    and its extremes, the ranks are known, and its rows are spread by the hash of ``key``, the
    columns that tell rows apart. Rows with a null group are dropped. ``df`` is read four
    times: pass a stored table. ``rows`` is the number of non-null values, if it is known.
    """
    by, cell = list(by), [*by, "_range"]
    task_rows = max(1, task_rows)
    given = (df.dropna(subset=by) if by else df).withColumn("_v", nan_as_null(value))
    known = given.where("_v is not null")
    rows = known.count() if rows is None else rows
    binned = with_range(known, "_v", find_ranges(known, "_v", rows, task_rows), "_range")

    counts = written(
        binned.groupBy(*cell).agg(
            F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
        ),
        "range_counts",
    )
    is_hot = (F.col("_n") > task_rows) & (F.col("_least") == F.col("_most"))
    found = counts.agg(F.count("*").alias("cells"), F.count_if(is_hot).alias("hot")).first()
    before = Window.partitionBy(*by, F.lit(0)).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    spreads = F.when(is_hot, F.ceil(F.col("_n") / task_rows)).otherwise(1)
    below = counts.select(
        *cell, "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_below"),
        is_hot.alias("_hot"), spreads.cast("bigint").alias("_spreads"),
    )

    if found.hot:
        hot = counts.where(is_hot).select(*cell, spreads.cast("bigint").alias("_spreads"))
        hot = F.broadcast(hot) if found.hot <= BROADCAST_ROWS else hot
        spread = F.coalesce(F.pmod(F.xxhash64(*key), F.col("_spreads")), F.lit(0))
        binned = binned.join(hot, cell, "left").withColumn("_spread", spread).drop("_spreads")
    else:
        binned = binned.withColumn("_spread", F.lit(0).cast("bigint"))
    # A row for each task of a hot range; few rows are sent, many are met by the same key
    below = below.select(
        *cell, "_n", "_below", "_hot",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_spreads") - 1)).alias("_spread"),
    )
    if found.cells <= BROADCAST_ROWS:
        below = F.broadcast(below)
    place = Window.partitionBy(*cell, "_spread").orderBy("_v")
    inside = F.when(F.col("_hot"), (F.col("_n") + 1) / 2.0).otherwise(
        (F.col("_first") + F.col("_last")) / 2.0
    )
    ranked = (
        binned.withColumns({"_first": F.rank().over(place), "_last": F.count("*").over(place)})
        .join(below, [*cell, "_spread"])
        .select(*df.columns, (F.col("_below") + inside).cast("double").alias(out))
    )
    if not keep_nulls:
        return ranked
    unranked = given.where("_v is null").select(*df.columns, F.lit(None).cast("double").alias(out))
    return ranked.unionByName(unranked)
