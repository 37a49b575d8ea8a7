"""Exact percentiles per group by selection; one way for groups of every size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import nan_as_null
from ..sources.scratch import written
from .aggregates import carried
from .splits import with_cut

TASK_ROWS = 250_000  # rows of one group, or of one cut of it, that a task puts in order
PIVOTS = 31
BROADCAST_ROWS = 20_000  # of pivot rows, some 300 bytes each
MOST_ROUNDS = 10  # each leaves about a thirtieth of a cell, so 2**63 rows need no more


def grouped_percentiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    task_rows: int = TASK_ROWS,
    carry: Mapping[str, str] | None = None,
    stored: bool = False,
) -> DataFrame:
    """``by`` columns, ``n`` and ``percentiles`` (interpolated, one per probability).

    A percentile is a mix of the two values at the places around ``(n - 1) * p``. A group of up
    to ``task_rows`` rows is put in order in one task. A larger one is cut at pivots near its
    quantiles and counted; the cuts that hold a wanted place are cut and counted again until
    they fit a task, so of a large group only those rows are ever shuffled. A cut that is a
    pivot itself holds one value, however often, and needs no order. ``task_rows`` decides where
    the two values are found, never which they are: results are equal to the last bit.

    Null keys are dropped; NaN counts as null; a group without values has null percentiles.
    ``carry`` maps an output name to an attribute that depends on the key. The needed columns
    are stored once, unless ``stored`` says that ``df`` is cheap to read again.
    """
    by, probs, carry = list(by), [float(p) for p in probs], dict(carry or {})
    task_rows = max(1, task_rows)
    rows = df.dropna(subset=by).select(
        *by, nan_as_null(value).alias("_v"), *[F.col(c).alias(f"_c_{o}") for o, c in carry.items()]
    )
    if not stored:
        rows = written(rows, "percentiles")
    groups = written(rows.groupBy(*by).agg(F.count("_v").alias("n")), "group_sizes")
    is_large = F.col("n") > task_rows
    found = groups.agg(F.count_if(is_large).alias("large"), F.count("*").alias("all")).first()

    known = rows.where("_v is not null").select(*by, "_v")
    if not found.large:
        placed = _in_order(known.join(groups, by), by)
    else:
        large = groups.where(is_large)
        placed = _selected(known, large, by, probs, task_rows, found.large)
        if found.large < found.all:
            keys = large.select(*by)
            keys = F.broadcast(keys) if found.large <= BROADCAST_ROWS else keys
            small = known.join(keys, by, "left_anti").join(groups, by)
            placed = _in_order(small, by).unionByName(placed)

    # ``_v`` stands at the places from ``_from`` up to ``_to``
    picked = []
    for i, p in enumerate(probs):
        at = (F.col("n") - 1) * F.lit(p)
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (place >= F.col("_from")) & (place < F.col("_to"))
            picked.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}{i}"))
    found_values = placed.groupBy(*by).agg(*picked)
    result = groups.join(found_values, by, "left")
    if carry:
        result = result.join(carried(rows, by, {f"_c_{o}": o for o in carry}), by)
    mixed = F.array(*[_between(F.col(f"_lo{i}"), F.col(f"_hi{i}"), p) for i, p in enumerate(probs)])
    return result.select(*by, "n", F.when(F.col("n") > 0, mixed).alias("percentiles"), *carry)


def grouped_median(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    out: str,
    task_rows: int = TASK_ROWS,
    carry: Mapping[str, str] | None = None,
    stored: bool = False,
) -> DataFrame:
    p = grouped_percentiles(df, by, value, [0.5], task_rows, carry, stored)
    return p.select(*by, F.element_at("percentiles", 1).alias(out), *(carry or {}))


def _between(low: Column, high: Column, p: float) -> Column:
    """The one formula of a percentile: the share of each neighbour is its nearness."""
    at = (F.col("n") - 1) * F.lit(p)
    share = at - F.floor(at)
    return F.when(low == high, low).otherwise(low * (1 - share) + high * share)


def _in_order(rows: DataFrame, by: list[str]) -> DataFrame:
    """Each row at its own place within its group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_v")) - 1
    return rows.select(
        *by, "n", place.cast("bigint").alias("_from"), (place + 1).cast("bigint").alias("_to"), "_v"
    )


def _selected(
    known: DataFrame, large: DataFrame, by: list[str], probs: list[float], task_rows: int, cells: int
) -> DataFrame:
    """Values at the wanted places of groups that are too large for one task."""
    cell = [*by, "_cell"]
    wanted = lambda first, end: F.exists(
        F.array(
            *[edge((F.col("n") - 1) * F.lit(p)).cast("bigint") for p in probs for edge in (F.floor, F.ceil)]
        ),
        lambda place: (place >= first) & (place < end),
    )
    sized = large.select(*by, "n")
    sized = F.broadcast(sized) if cells <= BROADCAST_ROWS else sized
    rows = known.join(sized, by).select(
        *by, "n", "_v", F.lit(0).cast("bigint").alias("_cell"), F.lit(0).cast("bigint").alias("_below")
    )
    found = []
    for number in range(MOST_ROUNDS):
        probes = [i / (PIVOTS + 1) for i in range(1, PIVOTS + 1)]
        pivots = written(
            rows.groupBy(*cell).agg(
                F.array_distinct(F.percentile_approx("_v", probes, 1000)).alias("_pivots")
            ),
            "pivots",
        )
        if cells <= BROADCAST_ROWS:
            pivots = F.broadcast(pivots)
        # Odd cuts are the pivots themselves, even ones what lies between
        binned = with_cut(rows.join(pivots, cell), "_pivots", PIVOTS, "_v", "_cut").drop("_pivots")
        upto = F.sum("_rows").over(Window.partitionBy(*cell).orderBy("_cut"))
        cuts = written(
            binned.groupBy(*cell, "n", "_below", "_cut")
            .agg(F.count("*").alias("_rows"), F.min("_v").alias("_v"))
            .withColumn("_to", F.col("_below") + upto)
            .withColumn("_from", F.col("_to") - F.col("_rows"))
            # A column of its own: a condition on ``_cut`` would be carried over to the rows
            .withColumn("_single", F.col("_cut") % 2 == 1)
            .where(wanted(F.col("_from"), F.col("_to"))),
            "cuts",
        )
        found.append(cuts.where("_single").select(*by, "n", "_from", "_to", "_v"))
        more = cuts.where("not _single")
        fits = F.col("_rows") <= (task_rows if number + 1 < MOST_ROUNDS else 2**63 - 1)
        left = more.agg(F.count("*").alias("cells"), F.count_if(~fits).alias("large")).first()
        if not left.cells:
            break
        next_cells = more.select(*cell, "_cut", "_from", "_rows")
        next_cells = F.broadcast(next_cells) if left.cells <= BROADCAST_ROWS else next_cells
        inside = binned.join(next_cells, [*cell, "_cut"]).select(
            *by, "n", "_v", (F.col("_cell") * 64 + F.col("_cut")).alias("_cell"),
            F.col("_from").alias("_below"), "_rows",
        )
        if left.large:
            inside = written(inside, "cells")
        ordered = Window.partitionBy(*cell).orderBy("_v")
        place = F.col("_below") + F.row_number().over(ordered)
        found.append(
            inside.where(fits)
            .select(*by, "n", (place - 1).alias("_from"), place.alias("_to"), "_v")
        )
        if not left.large:
            break
        rows, cells = inside.where(~fits).drop("_rows"), left.large
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out
