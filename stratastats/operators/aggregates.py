"""Group sums and carried attributes. Rows with a null key are dropped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

from .exactsum import added, combined, digit_sums
from .reshape import without_nan


def carry_first(column: str, out: str | None = None) -> Column:
    """An attribute that depends on the group key; ``min`` makes the pick repeatable."""
    return F.min(column).alias(out or column)


def carried(df: DataFrame, by: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Attributes (column -> name in the result) per group, as :func:`carry_first` picks them.

    The distinct rows are hashed out first, so that only they are sorted for the smallest text.
    """
    by = list(by)
    rows = df.dropna(subset=by).select(*by, *[F.col(c).alias(o) for c, o in columns.items()])
    return rows.distinct().groupBy(*by).agg(*[carry_first(o) for o in columns.values()])


def group_sum(
    df: DataFrame,
    by: Sequence[str],
    amount: str,
    carry: Sequence[str] = (),
    cluster: Sequence[str] = (),
    exact: bool | int = False,
) -> DataFrame:
    """Sum ``amount`` per group (0 for a group without values) beside carried attributes.

    ``min`` of a text column would make Spark sort all rows before the first
    aggregation. Attributes are therefore grouped on first, which hashes and
    shrinks the data on the map side; one value per key is settled afterwards.
    ``cluster`` names the keys of ``by`` to partition that second step by, so that a
    later join on them needs no further shuffle. NaN is missing. Sums of doubles depend on the
    order of tasks in their last bits. ``exact=True`` adds whole digits instead, the same in any
    order, at about three times the cost; a number adds decimals of that many places (money: 2).
    """
    by, carry = list(by), [c for c in carry if c not in by]
    rows = without_nan(df, amount).dropna(subset=by)
    kind = rows.schema[amount].dataType
    inexact = isinstance(kind, (DoubleType, FloatType))
    if exact is True and inexact:
        digits = digit_sums(rows, [*by, *carry], [F.col(amount)])
        # All later steps are clustered by these keys
        digits = digits.repartition(*(cluster or by))
        firsts = [carry_first(c) for c in carry]
        found = combined(added(digits, by, *firsts), by, [amount], firsts)
        return found.withColumn(amount, F.coalesce(amount, F.lit(0.0)))
    if exact is not False and inexact:
        rows = rows.withColumn(amount, F.col(amount).cast(f"decimal(38, {exact})"))
        return group_sum(rows, by, amount, carry, cluster).withColumn(
            amount, F.col(amount).cast("double")
        )
    sums = rows.groupBy(*by, *carry).agg(F.sum(amount).alias(amount))
    if carry:
        sums = sums.repartition(*cluster) if cluster else sums
        sums = sums.groupBy(*by).agg(F.sum(amount).alias(amount), *[carry_first(c) for c in carry])
    return sums.withColumn(amount, F.coalesce(amount, F.lit(0)))
