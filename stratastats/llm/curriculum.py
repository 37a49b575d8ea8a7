"""Mixing sources to target weights along a time-varying curriculum.

A source has a weight schedule over training time 0 to 1. The integral of the schedule is its
share of the words of the mix; its running integral says how many of its words the mix has asked
for by a time. Documents of a source stand in a fixed random order; the words before a document
are inverted through the running integral to the time at which it is due. Sorting by that time
gives the training order. Everything is built-in column expressions: running sums over a hot
source are taken in cells of its order, with one offset per cell.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratastats.sources import written

from .common import WORD, pick

Schedule = Sequence[tuple[float, float]]  # (time, weight), from time 0 to time 1
CELL_ROWS = 512  # documents of the largest source in one cell, about
MAX_SOURCES = 100_000  # sources are planned on the driver


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess reshared."""
    caps = {s: most * n for s, n in sizes.items()}
    open_, left, out = {s for s in sizes if weights[s] > 0}, float(total), dict.fromkeys(sizes, 0.0)
    while open_:
        weight = sum(weights[s] for s in open_)
        full = {s for s in open_ if left / weight * weights[s] > caps[s]}
        if not full:
            return out | {s: left / weight * weights[s] for s in open_}
        for s in full:
            out[s] = float(caps[s])
            left -= caps[s]
        open_ -= full
    return out


def plan(
    docs: DataFrame,
    schedule_of: Callable[[int, str | None], Schedule],
    volume: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, positions) for every row.

    ``schedule_of(number, source)`` gives the schedule of a source; sources are numbered by code
    point, null last. The mix has ``volume`` times all words; a source gives at most ``most``
    times its own. ``positions`` are the times, in order, at which the document is used: none, one
    or several; ``taken`` is its size times their number. A document is used again only after all
    of its source were, and a use counts if its middle lies below the target, so that a source
    misses its target by half a document at most. Null texts have size 0. Repeated rows are
    documents of their own. Reruns agree: the order comes from a hash of the id, of the text where
    the id is null. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sized = written(
        pick(docs, doc_id=id_col, source=source_col, text=text_col).select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            # rows without an id are spread by their text
            F.md5(
                F.coalesce(F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")).cast("binary")
            ).alias("turn"),
            F.xxhash64("text").alias("body"),
        ),
        "sizes",
    )
    sums = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        .limit(MAX_SOURCES + 1)
        .collect()
    )
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    order = sorted((r["source"] for r in sums), key=lambda s: (s is None, s or ""))
    schedules = {s: list(schedule_of(i, s)) for i, s in enumerate(order)}
    sizes = {r["source"]: r["size"] for r in sums}
    wanted = targets(
        sizes, {s: integral(schedules[s]) for s in order}, volume * sum(sizes.values()), most
    )
    rows = [(s, sizes[s], wanted[s], _segments(schedules[s])) for s in order]
    schema = (
        "own string, source_size bigint, target double, "
        "segments array<struct<upto:double,before:double,t0:double,t1:double,w0:double,w1:double>>"
    )
    sources = F.broadcast(spark.createDataFrame(rows, schema))  # at most MAX_SOURCES rows

    largest = max((r["n"] for r in sums), default=0)
    cells = max(1, -(-largest // CELL_ROWS))
    cell = F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * cells / 2**32)
    celled = sized.withColumn("cell", cell.cast("long"))
    offsets = (
        celled.groupBy("source", "cell")
        .agg(F.sum("size").alias("words"))
        .select(
            F.col("source").alias("source_"),
            F.col("cell").alias("cell_"),
            (F.sum("words").over(Window.partitionBy("source").orderBy("cell")) - F.col("words")).alias(
                "ahead"
            ),
        )
    )
    inside = Window.partitionBy("source", "cell").orderBy("turn", "doc_id", "size", "body")
    begin = F.col("ahead") + F.sum("size").over(
        inside.rowsBetween(Window.unboundedPreceding, 0)
    ) - F.col("size")
    placed = (
        celled.join(
            offsets, F.col("source").eqNullSafe(F.col("source_")) & (F.col("cell") == F.col("cell_"))
        )
        .withColumn("begin", begin)
        .join(sources, F.col("source").eqNullSafe(F.col("own")))
    )
    uses = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(max(0, int(-(-most // 1)) - 1))),
            lambda e: e * F.col("source_size") + F.col("begin") + F.col("size") / 2.0,
        ),
        lambda middle: middle < F.col("target"),
    )
    positions = F.transform("uses", lambda m: _time(m / F.col("target")))
    return placed.withColumn("uses", uses).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.size("uses") * F.col("size")).cast("long").alias("taken"),
        positions.alias("positions"),
        "body",
    )


def _segments(schedule: Schedule) -> list[tuple]:
    whole, before, out = integral(schedule), 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        if t1 > t0 and whole > 0:
            part = (t1 - t0) * (w0 + w1) / 2 / whole
            out.append((before + part, before, t0, t1, w0 / whole, w1 / whole))
            before += part
    return out


def _time(demand: Column) -> Column:
    """The time at which the running integral of the schedule reaches ``demand`` (0 to 1)."""
    s = F.element_at(
        F.filter(
            "segments",
            lambda x: (x["upto"] > demand) | (x["upto"] == F.element_at("segments", -1)["upto"]),
        ),
        1,
    )
    slope = (s["w1"] - s["w0"]) / (s["t1"] - s["t0"])
    need = F.greatest(demand - s["before"], F.lit(0.0))
    root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * slope * need, F.lit(0.0)))
    return F.least(s["t0"] + 2 * need / F.greatest(s["w0"] + root, F.lit(1e-300)), s["t1"])


def in_order(planned: DataFrame) -> DataFrame:
    """The plan with each document's first and last time of use, ``position`` and ``last_position``,
    range-sorted by the first; documents that are not used have none and come last, spread by a hash."""
    unused = 2 + F.pmod(F.xxhash64("doc_id", "body"), F.lit(1 << 30)) / float(1 << 30)
    timed = planned.withColumns(
        {"position": F.try_element_at("positions", F.lit(1)), "last_position": F.try_element_at("positions", F.lit(-1))}
    )
    return timed.orderBy(F.coalesce("position", unused), "doc_id", "body")


def mixed(docs: DataFrame, planned: DataFrame) -> DataFrame:
    """The documents in training order, one row per use, with the columns of ``docs``.

    The n-th of equal rows (id, source and text) takes the n-th of their plans. Null ids, texts and
    sources are values like others; an empty table gives no rows.
    """
    # documents and plans share one shuffle by the key; the sorts inside it number them and set
    # each plan before its document, so that equal rows meet one to one and never all with all
    def key(doc, source):
        return [
            F.coalesce(doc, F.lit(-(2**63))).alias("_id"),
            F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("_source"),
        ]

    same = ["_id", "_source", "_body"]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    uses = planned.select(
        *key(F.col("doc_id"), F.col("source")),
        F.col("body").alias("_body"),
        F.lit(0).alias("_kind"),
        F.col("positions").alias("_positions"),
    )
    base = docs.select(
        *key(F.col("doc_id"), F.col("source")), F.xxhash64("text").alias("_body"), F.lit(1).alias("_kind"), row
    )
    number = F.row_number().over(Window.partitionBy(*same, "_kind").orderBy("_positions"))
    plan_of = F.lag("_positions").over(Window.partitionBy(*same, "_n").orderBy("_kind"))
    return (
        base.unionByName(uses, allowMissingColumns=True)
        .repartition(*same)
        .withColumn("_n", number)
        .withColumn("_positions", plan_of)
        .filter("_kind = 1")
        .withColumn("_position", F.explode("_positions"))
        .orderBy("_position", "_id", "_body")
        .select("_row.*")
    )
