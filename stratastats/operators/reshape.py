"""Long and wide forms."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions import nan_as_null


def unpivot_drop_null(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "sector",
    value: str = "value",
) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value).dropna(subset=[value])


def flatten_map(df: DataFrame, outer: str, nested: Column | str, inner: str = "inner",
                value: str = "value") -> DataFrame:
    """One ``(outer, inner, value)`` row per entry of a map column."""
    nested = F.col(nested) if isinstance(nested, str) else nested
    return df.select(outer, F.explode(nested).alias(inner, value))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; a column missing from a frame is null there."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def without_nan(df: DataFrame, *columns: str) -> DataFrame:
    """NaN of the floating-point columns named as null; other types have none."""
    return df.withColumns(
        {
            c: nan_as_null(c)
            for c in columns
            if isinstance(df.schema[c].dataType, (DoubleType, FloatType))
        }
    )
