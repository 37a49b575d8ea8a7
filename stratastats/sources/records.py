"""Records that run over line ends, read from splittable text.

Text is read in fragments that end at a separator: lines of delimited files, pieces up to a
closing brace of JSON. Whether a record ends with a fragment depends on all text before it: is a
quote open, how many braces are. Each split is therefore summed up under both states it may
start in: whether it turns the quotes around, how it changes the depth, and how deep it is at
the shallowest fragment end. Sums of these over the splits of a file tell each split its true
start, and then all splits are read side by side. A record that runs over the end of a split
is emitted in pieces, which are put together by the split that it starts in.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .scratch import written

BROADCAST_ROWS = 50_000  # splits that start within a record, some 200 bytes each
NEVER = 1 << 40  # deeper than any record


@dataclass(frozen=True)
class Grammar:
    """``fragment`` gives (quotes turned, depth change from outside, from inside a string)."""

    separator: str
    fragment: Callable[[str], tuple[int, int, int]]
    plain: Callable[[pa.Array], bool]  # every fragment is a record when the first one starts one
    between: Callable[[str], bool]  # no record starts in this fragment
    finished: Callable[[str], str]


def _line(text: str) -> tuple[int, int, int]:
    return text.count('"') & 1, 0, 0


def _even_quotes(values: pa.Array) -> bool:
    import pyarrow.compute as pc

    counts = pc.count_substring(values, '"')
    return not pc.any(pc.equal(pc.bit_wise_and(counts, 1), 1)).as_py()


LINES = Grammar("\n", _line, _even_quotes, lambda text: False, lambda text: text.removesuffix("\r"))

_ESCAPED = re.compile(r"\\.", re.S)


def _braces(text: str) -> tuple[int, int, int]:
    """The closing brace that ends the fragment counts where it is outside a string."""
    parts = _ESCAPED.sub("", text).split('"') if "\\" in text else text.split('"')
    turned = (len(parts) - 1) & 1
    opened = [sum(p.count("{") for p in parts[first::2]) for first in (0, 1)]
    return turned, opened[0] - (not turned), opened[1] - turned


def _object(text: str) -> str:
    return text[text.index("{") :] + "}"


OBJECTS = Grammar("}", _braces, lambda values: False, lambda text: "{" not in text, _object)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch, bool]]:
    """(split, its rows in this batch, whether the split begins here), in order."""
    import pyarrow.compute as pc

    last = None
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            rest = batch.slice(at)
            split = rest["file"][0].as_py(), rest["block"][0].as_py()
            same = pc.and_(pc.equal(rest["file"], rest["file"][0]), pc.equal(rest["block"], rest["block"][0]))
            length = pc.index(same, False).as_py()
            length = rest.num_rows if length < 0 else length
            yield split, rest.slice(0, length), split != last
            last, at = split, at + length


def _summary(grammar: Grammar, skip: int, header: bool):
    """One row per split: its effect from both starts, and the header of the split at byte 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        now: dict = {}

        def close() -> None:
            if now:
                done.append({k: v for k, v in now.items() if k not in ("skip", "held")})

        for (file, block), rows, begins in _runs(batches):
            if begins:
                close()
                top = block == 0
                now = {
                    "file": file, "block": block, "turned": 0, "delta0": 0, "delta1": 0,
                    "low0": NEVER, "low1": NEVER, "header": None,
                    "skip": skip if top else 0, "held": [] if top and header else None,
                }
            for text in rows["value"].to_pylist():
                if now["skip"]:
                    now["skip"] -= 1
                    continue
                turned, from0, from1 = grammar.fragment(text)
                change = (from0, from1)
                for s in (0, 1):
                    now[f"delta{s}"] += change[s ^ now["turned"]]
                now["turned"] ^= turned
                s = now["turned"]  # from this start no string is open here
                now[f"low{s}"] = min(now[f"low{s}"], now[f"delta{s}"])
                if now["held"] is not None:
                    now["held"].append(text)
                    if not now["turned"]:
                        now["header"], now["held"] = grammar.finished("\n".join(now["held"])), None
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema(
                [("file", pa.string()), ("block", pa.int64()), ("turned", pa.int64()),
                 ("delta0", pa.int64()), ("delta1", pa.int64()), ("low0", pa.int64()),
                 ("low1", pa.int64()), ("header", pa.string())]
            ))

    return run


def _records(grammar: Grammar, skip: int, header: bool):
    """Whole records (``file`` is null) and pieces of those that other splits share."""
    schema = pa.schema(
        [("value", pa.string()), ("file", pa.string()), ("owner", pa.int64()), ("block", pa.int64())]
    )

    def whole(values: list[str] | pa.Array) -> pa.RecordBatch:
        none = pa.nulls(len(values), pa.int64())
        values = pa.array(values, pa.string())
        return pa.RecordBatch.from_arrays([values, pa.nulls(len(values), pa.string()), none, none], schema=schema)

    def piece(value: str, split: tuple, owner: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"value": value, "file": split[0], "owner": owner, "block": split[1]}], schema=schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, quoted, depth, owner = None, [], 0, 0, None
        to_skip, drop = 0, False
        for now, rows, begins in _runs(batches):
            if begins:
                if held:  # goes on in the next split
                    yield piece(grammar.separator.join(held) + grammar.separator, split, split[1] if owner is None else owner)
                split, held = now, []
                quoted, depth, owner = (rows[c][0].as_py() for c in ("quoted", "depth", "owner"))
                to_skip, drop = (skip, header) if now[1] == 0 else (0, False)
            values = rows["value"]
            skipped = min(to_skip, len(values))
            values, to_skip = values.slice(skipped), to_skip - skipped
            if not (held or quoted or depth or drop) and grammar.plain(values):
                import pyarrow.compute as pc

                yield whole(pc.replace_substring_regex(values, r"\r$", "") if grammar.separator == "\n" else values)
                continue
            complete = []
            for text in values.to_pylist():
                if not (held or quoted or depth) and owner is None and grammar.between(text):
                    continue
                turned, *change = grammar.fragment(text)
                depth += change[quoted]
                quoted ^= turned
                held.append(text)
                if quoted or depth > 0:
                    continue
                record, held = grammar.separator.join(held), []
                if owner is not None:  # the rest of a record of an earlier split
                    yield piece(record, split, owner)
                    owner = None
                elif drop:
                    drop = False
                else:
                    complete.append(grammar.finished(record))
            if complete:
                yield whole(complete)
        if held:
            yield piece(grammar.separator.join(held) + grammar.separator, split, split[1] if owner is None else owner)

    return run


def read_records(
    spark: SparkSession, path: str, grammar: Grammar, skip: int = 0, header: bool = False
) -> tuple[DataFrame, list[str]]:
    """(``value``: one row per record, the distinct headers).

    ``skip`` leading lines of each file are no records, ``header`` says that the first record
    after them is one; at most two distinct headers are returned. A file that ends within a
    record raises an error that names it. The text is read twice, once for the summaries; where
    records run over the end of a split, those splits are read once more.
    """
    text = spark.read.option("lineSep", grammar.separator).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    found = written(
        text.mapInArrow(
            _summary(grammar, skip, header),
            "file string, block bigint, turned bigint, delta0 bigint, delta1 bigint, low0 bigint, "
            "low1 bigint, header string",
        ),
        "splits",
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole_file = Window.partitionBy("file")
    outside = F.col("quoted") == 0
    states = (
        found.withColumn("quoted", F.coalesce(F.sum("turned").over(before), F.lit(0)) % 2)
        .withColumn("delta", F.when(outside, F.col("delta0")).otherwise(F.col("delta1")))
        .withColumn("low", F.when(outside, F.col("low0")).otherwise(F.col("low1")))
        .withColumn("depth", F.coalesce(F.sum("delta").over(before), F.lit(0)))
        .withColumn("ends", F.col("depth") + F.col("low") <= 0)
        .withColumn("owner", F.last(F.when(F.col("ends"), F.col("block")), ignorenulls=True).over(before))
        .withColumn("owner", F.coalesce("owner", F.min("block").over(whole_file)))
        .withColumn("is_last", F.col("block") == F.max("block").over(whole_file))
    )
    states = written(states, "split_states")
    still_open = ((F.col("quoted") + F.col("turned")) % 2 == 1) | (F.col("depth") + F.col("delta") > 0)
    broken = states.where(F.col("is_last") & still_open).select("file").first()
    if broken:
        raise ValueError(f"{broken.file} ends within a record")
    headers = []
    if header:
        missing = states.where("block = 0 and header is null").select("file").first()
        if missing:
            raise ValueError(f"no header after {skip} lines in {missing.file}")
        headers = [r.header for r in states.where("block = 0").select("header").distinct().limit(2).collect()]

    inside = states.where("quoted = 1 or depth > 0").select(
        "file", "block", F.col("quoted").cast("int"), F.col("depth").cast("int"), "owner"
    )
    schema = "value string, file string, owner bigint, block bigint"
    of_split = _records(grammar, skip, header)
    crossing = inside.count()
    if not crossing:
        start = text.withColumns({"quoted": F.lit(0), "depth": F.lit(0), "owner": F.lit(None).cast("bigint")})
        return start.mapInArrow(of_split, schema).select("value"), headers

    def started(lines: DataFrame) -> DataFrame:
        if crossing <= BROADCAST_ROWS:  # keeps the order of the lines
            joined = lines.join(F.broadcast(inside), ["file", "block"], "left")
        else:
            joined = (
                lines.withColumn("_no", F.monotonically_increasing_id())
                .join(inside, ["file", "block"], "left")
                .repartition("file", "block")
                .sortWithinPartitions("file", "block", "_no")
            )
        return joined.select(
            "value", "file", "block", F.coalesce("quoted", F.lit(0)).alias("quoted"),
            F.coalesce("depth", F.lit(0)).alias("depth"), "owner",
        )

    records = started(text).mapInArrow(of_split, schema).where("file is null").select("value")
    shared = inside.select("file", "block").union(inside.select("file", "owner")).distinct()
    shared = F.broadcast(shared) if crossing <= BROADCAST_ROWS else shared
    # The pieces of a record are as many as the splits it touches
    finish = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("block", "value"))), lambda p: p["value"]), ""
    )
    pieces = (
        started(text.join(shared, ["file", "block"], "left_semi"))
        .mapInArrow(of_split, schema)
        .where("file is not null")
        .groupBy("file", "owner")
        .agg(finish.alias("value"))
    )
    if grammar is OBJECTS:
        joined = F.concat(F.regexp_extract("value", r"(?s)\{.*", 0), F.lit("}"))
    else:
        joined = F.regexp_replace("value", r"\r$", "")
    return records.unionByName(pieces.select(joined.alias("value"))), headers
