"""Hard negatives by exact integer scores from residue matrix products.

Scores are inner products of integer vectors. Components are reduced modulo several primes small
enough that a float32 matrix product of residues is exact, the products are reduced again, and
balanced mixed-radix digits (Chinese remaindering) give back the signed 64-bit score. The number
of primes follows from the largest component and length of a vector in the data.

Rows are dealt into shards and anchors into blocks by hash; every (shard, block) pair is one
group of bounded size that returns a few rows per anchor. The first round finds each anchor's
positives, multiplying only rows of an equal label. The second knows the positives' scores and
picks, for each of them, the best rows of another label inside its window of scores. Windows over
the anchor merge the shards' finds after each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import written
from .common import pick

SHARD_ROWS = BLOCK_ROWS = 8192
MIN_SHARDS = 32
TILE_CELLS = 1 << 22  # scores that are held at a time
EXACT = 1 << 24  # float32 holds all integers up to this
LARGEST_PRIME = 1021
NONE = -(2**63)  # below every score


def _primes(most: int) -> list[int]:
    sieve = np.ones(most + 1, bool)
    sieve[:2] = False
    for i in range(2, int(most**0.5) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    return np.flatnonzero(sieve)[::-1].tolist()


def moduli(bound: int) -> list[int]:
    """The largest primes whose product tells all integers from -bound to bound apart."""
    found, product = [], 1
    for p in _primes(LARGEST_PRIME):
        found.append(p)
        product *= p
        if product > 2 * bound:
            return found
    raise ValueError("no room")  # not reached for 64-bit scores


def _balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues between -(p - 1) / 2 and (p - 1) / 2."""
    half = (p - 1) // 2
    return (x + half) % p - half


class Residues:
    """Integer matrices modulo each prime, as float32."""

    def __init__(self, vectors: np.ndarray, primes: list[int]):
        self.primes = primes
        self.parts = [_balanced(vectors, p).astype(np.float32) for p in primes]

    def rows(self, at) -> "Residues":
        out = Residues.__new__(Residues)
        out.primes, out.parts = self.primes, [m[at] for m in self.parts]
        return out

    def scores(self, other: "Residues") -> np.ndarray:
        """All inner products with the rows of ``other``, exact as long as they fit the primes."""
        digits: list[np.ndarray] = []
        total, weight = None, 1
        for p, a, b in zip(self.primes, self.parts, other.parts):
            width = max(1, EXACT // ((p - 1) // 2) ** 2)  # columns whose sum stays exact
            left = np.zeros((len(a), len(b)), np.int32)
            for at in range(0, a.shape[1], width):
                product = a[:, at : at + width] @ b[:, at : at + width].T
                left = _balanced(left + product.astype(np.int32), p)
            # The next digit: what the digits so far leave of this residue
            for q, digit in zip(self.primes, digits):
                left = _balanced((left - digit) * pow(q, -1, p), p)
            digits.append(left)
            step = left.astype(np.int64) * np.int64(weight)
            total = step if total is None else total + step
            weight = (weight * p + 2**63) % 2**64 - 2**63  # wraps as the sum does
        return total


def _best(scores: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, score) of the k largest of each row, first places first; uses ``scores`` up."""
    rows = np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        at = scores.argmax(axis=1)
        value = scores[rows, at]
        live = value > NONE
        if not live.any():
            return
        yield rows[live], at[live], value[live]
        scores[rows, at] = NONE


def quantised(
    vectors: DataFrame,
    scale: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | str = "label",
) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of each component x as double; others left out.

    Left out: a null id or label, a null or empty vector, null or non-finite components.
    """
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    x = F.transform("v", lambda e: e.cast("double"))
    usable = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return (
        vectors.select(
            F.col(f"`{id_col}`").alias("vec_id"), label.alias("label"), F.col(f"`{vector_col}`").alias("v")
        )
        .select("vec_id", "label", x.alias("v"))
        .filter("vec_id is not null and label is not null and size(v) > 0")
        .filter(usable)
        .select("vec_id", "label", F.transform("v", lambda e: F.floor(e * scale)).alias("v"))
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _codes(rows: pa.Table, anchors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The labels of both as whole numbers."""
    both = pa.chunked_array(rows["label"].chunks + anchors["label"].chunks)
    codes = both.combine_chunks().dictionary_encode().indices.to_numpy()
    return codes[: rows.num_rows], codes[rows.num_rows :]


def _packed(found: list[tuple], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)


def _sorted(rows: pa.Table) -> pa.Table:
    return rows.sort_by("vec_id")  # equal scores then go to the smaller id


def _positives(primes: list[int], k: int, rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """Each anchor's k best other rows of its label in this shard."""
    found = []
    if rows.num_rows and anchors.num_rows:
        rows = _sorted(rows)
        ids, anchor_ids = rows["vec_id"].to_numpy(), anchors["anchor_id"].to_numpy()
        labels, anchor_labels = _codes(rows, anchors)
        ours, theirs = Residues(_matrix(rows["v"]), primes), Residues(_matrix(anchors["v"]), primes)
        for label in np.unique(anchor_labels):
            own, asked = np.flatnonzero(labels == label), np.flatnonzero(anchor_labels == label)
            if not len(own):
                continue
            members = ours.rows(own)
            for part in _tiles(asked, len(own)):
                scores = theirs.rows(part).scores(members)
                scores[ids[own][None, :] == anchor_ids[part][:, None]] = NONE
                for row, at, value in _best(scores, k):
                    found.append((anchor_ids[part][row], ids[own][at], value))
    return _packed(found, ["anchor_id", "vec_id", "score"])


def _tiles(rows: np.ndarray, width: int) -> Iterator[np.ndarray]:
    step = max(1, TILE_CELLS // max(1, width))
    for at in range(0, len(rows), step):
        yield rows[at : at + step]


def _negatives(primes: list[int], k: int, low: int, high: int, rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """For each positive of an anchor the k best rows of another label inside its window."""
    found = []
    if rows.num_rows and anchors.num_rows:
        rows = _sorted(rows)
        ids, anchor_ids = rows["vec_id"].to_numpy(), anchors["anchor_id"].to_numpy()
        labels, anchor_labels = _codes(rows, anchors)
        known = anchors["positives"].to_pylist()
        most = max(len(p) for p in known)
        target = np.full((len(known), most), NONE, np.int64)
        for i, p in enumerate(known):
            target[i, : len(p)] = p
        ours, theirs = Residues(_matrix(rows["v"]), primes), Residues(_matrix(anchors["v"]), primes)
        for part in _tiles(np.arange(len(anchor_ids)), len(ids)):
            scores = theirs.rows(part).scores(ours)
            scores[labels[None, :] == anchor_labels[part][:, None]] = NONE
            for j in range(most):
                wanted = target[part, j]
                there = np.flatnonzero(wanted > NONE)
                # low * p <= 100 * s <= high * p, as bounds of s in whole numbers
                least = -((-low * wanted[there]) // 100)
                largest = (high * wanted[there]) // 100
                own = scores[there]
                own[(own < least[:, None]) | (own > largest[:, None])] = NONE
                for row, at, value in _best(own, k):
                    asked = part[there[row]]
                    place = np.full(len(row), j + 1)
                    found.append((anchor_ids[asked], place, ids[at], value))
    return _packed(found, ["anchor_id", "place", "vec_id", "score"])


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Both tables hold (vec_id, label, v) with integer components. An anchor's positives are its
    first ``positives`` other rows of its label; for each, the first ``negatives`` rows of
    another label with ``low * positive <= 100 * negative <= high * positive``. Higher scores
    come first, ties go to the smaller id. Fewer rows than wanted give all there are; an anchor
    without positives, or a positive without a row in its window, gives none. Vectors meet those
    of their own length. Repeated rows each count, but rows with the anchor's id are never its
    positives; of repeated anchor ids the row with the smallest (label, v) asks.
    Nulls must have been left out (``quantised`` does). Empty tables give no rows. ``low`` and
    ``high`` times a score must fit 64 bits: components too large for that raise an error.
    """
    squares = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e)
    rows = vectors.select("vec_id", "label", F.size("v").alias("size"), "v")
    asked = written(
        pick(anchors, vec_id="vec_id", label="label", v="v")
        .groupBy("vec_id")
        .agg(F.min(F.struct("label", "v")).alias("one"))
        .select(F.col("vec_id").alias("anchor_id"), "one.label", F.size("one.v").alias("size"), "one.v"),
        "anchors",
    )
    of_rows = rows.agg(F.count("*").alias("n"), F.max(squares).alias("s")).first()
    of_anchors = asked.agg(F.count("*").alias("n"), F.max(squares).alias("s")).first()
    # No inner product is larger than the product of the lengths; a little for rounding
    bound = int(((of_rows.s or 0) * (of_anchors.s or 0)) ** 0.5 * 1.001) + 1
    if bound * max(low, high, 100) >= 2**62:
        raise ValueError("scores of these components do not fit 64 bits")
    primes = moduli(bound)
    shards = max(MIN_SHARDS, -(-of_rows.n // SHARD_ROWS))
    blocks = max(1, -(-of_anchors.n // BLOCK_ROWS))

    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    cells = ["size", "shard", "block"]
    left = rows.select(
        "vec_id", "label", "v", "size", dealt("vec_id", shards).alias("shard"), spread(blocks).alias("block")
    )

    def meet(side: DataFrame, fn, schema: str) -> DataFrame:
        right = side.select("*", dealt("anchor_id", blocks).alias("block"), spread(shards).alias("shard"))
        return left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(fn, schema)

    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    chosen = written(
        meet(
            asked, partial(_positives, primes, positives), "anchor_id bigint, vec_id bigint, score bigint"
        )
        .withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= positives)
        .select("anchor_id", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
        "positives",
    )
    # At most ``positives`` scores of an anchor, in order of their place
    known = chosen.groupBy("anchor_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]
        ).alias("positives")
    )
    found = meet(
        asked.join(known, "anchor_id"),
        partial(_negatives, primes, negatives, low, high),
        "anchor_id bigint, place bigint, vec_id bigint, score bigint",
    )
    best = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best).cast("int"))
        .filter(F.col("rank") <= negatives)
        .join(chosen, ["anchor_id", "place"])
        .select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
    )
