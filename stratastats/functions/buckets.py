"""Left-closed buckets, label lookups and chart flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from .columns import ColumnLike, as_column


def bucket_index(c: ColumnLike, edges: Sequence[float]) -> Column:
    """0-based bucket of ``[edge[i], edge[i+1])``; the last bucket has no upper end.

    Null below the first edge and for null or NaN input.
    """
    if list(edges) != sorted(set(edges)):
        raise ValueError("edges must be strictly increasing")
    c = as_column(c)
    c = F.when(~F.isnan(c.cast("double")), c)
    out = F.when(c < F.lit(edges[0]), F.lit(None).cast("int"))
    for i, upper in enumerate(edges[1:]):
        out = out.when(c < F.lit(upper), F.lit(i))
    return out.when(c >= F.lit(edges[-1]), F.lit(len(edges) - 1))


def bucket_label(c: ColumnLike, edges: Sequence[float], labels: Sequence[str]) -> Column:
    if len(edges) != len(labels):
        raise ValueError("one label is needed per left edge")
    return decode(bucket_index(c, edges), dict(enumerate(labels)))


def decode(code: ColumnLike, labels: Mapping) -> Column:
    """Label of a code, null for a code without a label."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.try_element_at(table, as_column(code))


def label_order(c: ColumnLike, labels: Sequence[str]) -> Column:
    """0-based place in a custom order, null for an unknown label."""
    return decode(c, {label: i for i, label in enumerate(labels)})


def sign_flag(value: ColumnLike) -> Column:
    return F.when(as_column(value) > 0, F.lit("above")).otherwise(F.lit("not_above"))


def near_zero_flag(value: ColumnLike, domain: ColumnLike, share: float = 0.02) -> Column:
    return F.abs(as_column(value)) < F.lit(share) * as_column(domain)
