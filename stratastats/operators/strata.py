"""Composition of strata and its drift from the overall baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import Terms, label_order, near_zero_flag, sign_flag
from .exactsum import PARTS, combined, digit_sums


_TERMS = ["_num", "_den"]


def _class_digits(df: DataFrame, by: Sequence[str], cls: str, terms: Terms) -> DataFrame:
    """Sums of the terms per group and class, as digits that can be added up further, exactly."""
    return digit_sums(df.dropna(subset=[cls]), [*by, cls], [terms.num, terms.den])


def _share(sums: DataFrame, by: Sequence[str], cls: str, excluded: str | None) -> DataFrame:
    """Percentage of each class in the total of its group, without the excluded class.

    The window runs over aggregated rows: one per class of a group.
    """
    mean = F.try_divide(F.col("_num").cast("double"), F.col("_den").cast("double"))
    counted = sums if excluded is None else sums.where(F.col(cls) != excluded)
    # In the order of the classes, so that the total never depends on that of the rows
    group = Window.partitionBy(*by, F.lit(0)).orderBy(cls)
    total = F.sum("_mean").over(
        group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return counted.withColumn("_mean", mean).select(
        *by, cls, F.try_divide(F.col("_mean") * 100, total).alias("share")
    )


def composition(
    df: DataFrame,
    cls: str,
    terms: Terms,
    by: Sequence[str] = (),
    excluded: str | None = None,
) -> DataFrame:
    """Weighted composition in percent, per stratum if ``by`` is given.

    Only rows of a class enter that class's weighted mean. Null strata are dropped.
    """
    by = list(by)
    rows = df.dropna(subset=by) if by else df
    sums = combined(_class_digits(rows, by, cls, terms), [*by, cls], _TERMS)
    return _share(sums, by, cls, excluded)


def nominal_drift(
    df: DataFrame,
    stratum: str,
    cls: str,
    terms: Terms,
    excluded: str | None = None,
    sign: int = 1,
) -> DataFrame:
    """``stratum, class, drift``: baseline share minus the stratum's share.

    Classes are matched by name; a class that a stratum lacks gives no row. The
    baseline covers rows without a stratum too, and both come from one aggregation
    of the data.
    """
    # A second grouping set adds the strata up to the baseline, on one row per stratum
    # and class; the windows below run over those few rows.
    digits = _class_digits(df, [stratum], cls, terms)
    slots = ["_slot", "_place"]
    both = digits.groupingSets([[stratum, cls, *slots], [cls, *slots]], stratum, cls, *slots).agg(
        *[F.sum(c).alias(c) for c in PARTS], (F.grouping(stratum) == 1).alias("_overall")
    )
    both = combined(both, ["_overall", stratum, cls], _TERMS)
    shares = _share(both, ["_overall", stratum], cls, excluded)
    baseline = F.max(F.when(F.col("_overall"), F.col("share"))).over(Window.partitionBy(cls))
    return (
        shares.withColumn("drift", (baseline - F.col("share")) * sign)
        .where(~F.col("_overall") & F.col(stratum).isNotNull())
        .select(stratum, cls, "drift")
    )


def drift_domain(drift: DataFrame, by: Sequence[str] = (), stretch: float = 1.2) -> DataFrame:
    """Half-width ``domain`` of a symmetric axis, shared or per stratum."""
    widest = F.greatest(F.abs(F.min("drift")), F.abs(F.max("drift")))
    return drift.groupBy(*by).agg((widest * stretch).alias("domain"))


def with_drift_flags(
    drift: DataFrame, share: float = 0.02, by: Sequence[str] = ()
) -> DataFrame:
    """Add the sign and whether a value is too close to zero for its axis.

    The axis is shared by all rows, or by those of a stratum that ``by`` names.
    """
    # One row per stratum and class: few enough for the window of the shared axis
    shared = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    widest = F.max(F.abs("drift")).over(shared)
    return drift.withColumns(
        {"flag": sign_flag("drift"), "near_zero": near_zero_flag("drift", widest, share)}
    )


def select_strata(df: DataFrame, stratum: str, wanted: Sequence) -> DataFrame:
    return df.where(F.col(stratum).isin(list(wanted)))


def sort_custom_order(df: DataFrame, column: str, labels: Sequence[str], *then: str) -> DataFrame:
    """Order rows by the place of a label in a list and expose it as ``label_no``."""
    return df.withColumn("label_no", label_order(column, labels)).orderBy("label_no", *then)
