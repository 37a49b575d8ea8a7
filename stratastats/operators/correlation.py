"""Spearman correlation, overall or per stratum, on pairwise-complete rows."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import nan_as_null
from ..sources.scratch import written
from .rank import TASK_ROWS, average_rank


def spearman(
    df: DataFrame,
    columns: Sequence[str],
    key: Sequence[str],
    by: Sequence[str] = (),
    pairs: Sequence[tuple[str, str]] | None = None,
    stored: bool = False,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Long table ``by..., a, b, rho``; all ordered pairs unless ``pairs`` names some.

    ``key`` identifies a row. All columns are ranked together in one long frame:
    one shuffle to rank, one to bring a row's ranks back side by side, however many
    columns there are. Where a column has nulls, the pairs that use it are ranked
    again on the rows where it is present. A constant column gives a null ``rho``.
    ``stored=True`` says that ``df`` is already a stored table, cheap to read again.
    """
    columns, key, by = list(columns), list(key), list(by)
    slim = df.select(*key, *by, *[nan_as_null(c).alias(c) for c in columns])
    slim = slim.dropna(subset=by) if by else slim
    if not stored:
        slim = written(slim, "spearman")
    counts = slim.agg(F.count("*").alias("_all"), *[F.count(c).alias(c) for c in columns]).first()
    partial = {c for c in columns if counts[c] < counts["_all"]}

    if pairs is None:
        wanted = list(itertools.combinations_with_replacement(columns, 2))
    else:
        wanted = list(pairs)
    scopes: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    for pair in wanted:
        scopes.setdefault(tuple(sorted(partial & set(pair))), []).append(pair)

    cells, names, values = [], {}, 0
    for number, (needed, members) in enumerate(scopes.items()):
        complete = F.lit(True)
        for c in needed:
            complete = complete & F.col(c).isNotNull()
        for c in dict.fromkeys(itertools.chain(*members)):
            slot = F.struct(F.lit(len(names)).alias("_slot"), F.col(c).alias("_value"))
            cells.append(F.when(complete, slot))
            names[number, c] = f"r{len(names)}"
            values += counts[c]  # an upper bound where rows are missing
    # A slot is one column on one set of complete rows.
    long = slim.select(*key, *by, F.inline(F.array_compact(F.array(*cells))))
    ranked = average_rank(
        long, "_value", [*key, "_slot"], [*by, "_slot"], "_rank", task_rows, keep_nulls=False,
        rows=values,
    )
    wide = ranked.groupBy(*by, *key).agg(
        *[
            F.max(F.when(F.col("_slot") == i, F.col("_rank"))).alias(r)
            for i, r in enumerate(names.values())
        ]
    )

    rows = []
    for number, members in enumerate(scopes.values()):
        for a, b in members:
            rho = _correlation(names[number, a], names[number, b])
            for x, y in {(a, b), (b, a)} if pairs is None else {(a, b)}:
                rows.append(
                    F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), rho.alias("rho"))
                )
    return wide.groupBy(*by).agg(F.array(*rows).alias("_rows")).select(*by, F.inline("_rows"))


def _correlation(a: str, b: str) -> Column:
    """Pearson correlation of two rank columns; null, not an error, for a constant one."""
    if a == b:
        return F.when(F.stddev_pop(a) > 0, F.lit(1.0))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pivot_matrix(long: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The square form of a long correlation table, one row per column name."""
    return long.groupBy("a").pivot("b", list(columns)).agg(F.first("rho"))
