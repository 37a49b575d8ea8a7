"""Looking at a table: nulls, types, samples, summary statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions import nan_as_null
from .quantiles import TASK_ROWS, grouped_percentiles


def _missing(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def null_profile(df: DataFrame) -> DataFrame:
    """``column, nulls`` in one pass; NaN counts as missing."""
    rows = [
        F.struct(F.lit(c).alias("column"), F.count_if(_missing(df, c)).alias("nulls"))
        for c in df.columns
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def schema_profile(df: DataFrame) -> DataFrame:
    """``column, dtype, non_null, row_count`` in one pass."""
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.count_if(~_missing(df, f.name)).alias("non_null"),
            F.count(F.lit(1)).alias("row_count"),
        )
        for f in df.schema.fields
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def head_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """``n`` rows, the same ones for the same seed: the smallest hashes of key and seed."""
    mixed = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    return df.orderBy(mixed, *key).limit(n)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def describe_numeric(
    df: DataFrame, columns: Sequence[str], task_rows: int = TASK_ROWS
) -> DataFrame:
    """``column, count, mean, std, min, q25, q50, q75, max`` with exact quartiles.

    ``df`` is read several times: pass a stored table.
    """
    values = df.select(*[nan_as_null(c).alias(c) for c in columns])
    moments = values.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"),
                    F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
                )
                for c in columns
            ]
        ).alias("r")
    ).select(F.inline("r"))
    cells = [F.struct(F.lit(i).alias("slot"), F.col(c).alias("value")) for i, c in enumerate(columns)]
    quartiles = grouped_percentiles(
        values.select(F.inline(F.array(*cells))), ["slot"], "value", [0.25, 0.5, 0.75],
        task_rows, stored=True,
    )
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("slot") + 1)
    quartiles = quartiles.select(names.alias("column"), "percentiles")
    # One row per described column.
    return moments.join(F.broadcast(quartiles), "column", "left").select(
        "column", "count", "mean", "std", "min",
        *[F.element_at("percentiles", i + 1).alias(q) for i, q in enumerate(["q25", "q50", "q75"])],
        "max",
    )
