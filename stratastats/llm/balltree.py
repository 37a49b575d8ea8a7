"""Exact largest inner products by branch and bound over ball trees.

Vectors are dealt into shards of bounded size by a hash of their id, queries into blocks. Every
(shard, block) pair is one group: it builds the shard's ball tree, prunes nodes whose bound
``q.c + |q| r`` cannot reach the query's current kth score, and visits the remaining leaves of
each query from the largest bound down. The kth score starts from a small pilot that all shards
share, so that a shard begins with a bound found elsewhere. A window over the query then merges
the shards' few survivors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import pick

SHARD_ROWS = 4096  # vectors in one tree
BLOCK_QUERIES = 4096  # queries that meet a tree at a time
PILOT_ROWS = 2048  # vectors that give the first kth scores
LEAF = 64


class BallTree:
    """Levels of balls over integer vectors; the leaves are consecutive ranges of ``order``."""

    def __init__(self, vectors: np.ndarray):
        x = vectors.astype(np.float64)
        self.order = np.arange(len(x))
        spans = [(0, len(x))]
        self.levels = [self._balls(x, spans)]
        self.children: list[np.ndarray] = []
        while any(b - a > LEAF for a, b in spans):
            below, first = [], []
            for a, b in spans:
                first.append(len(below))
                if b - a <= LEAF:
                    below.append((a, b))
                    continue
                own = self.order[a:b]
                part = x[own]
                center = part.mean(axis=0)
                far = part[np.argmax(((part - center) ** 2).sum(axis=1))]
                other = part[np.argmax(((part - far) ** 2).sum(axis=1))]
                side = np.argsort(part @ (other - far), kind="stable")  # equal points halve too
                self.order[a:b] = own[side]
                mid = (a + b) // 2
                below += [(a, mid), (mid, b)]
            self.children.append(np.append(first, len(below)))
            spans = below
            self.levels.append(self._balls(x, spans))
        self.leaves = spans

    def _balls(self, x: np.ndarray, spans: list) -> tuple[np.ndarray, np.ndarray]:
        centers = np.stack([x[self.order[a:b]].mean(axis=0) for a, b in spans])
        radii = [
            np.sqrt(((x[self.order[a:b]] - c) ** 2).sum(axis=1).max())
            for (a, b), c in zip(spans, centers)
        ]
        return centers, np.array(radii)

    def bounds(self, level: int, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """No inner product in the ball is larger (a little is added for rounding)."""
        centers, radii = self.levels[level]
        reach = queries @ centers.T + norms[:, None] * radii[None, :]
        return reach + 1e-6 * (1 + np.abs(reach) + norms[:, None] * np.abs(centers).max())


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; through floating point only where that is exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def search(
    ids: np.ndarray,
    vectors: np.ndarray,
    query_ids: np.ndarray,
    queries: np.ndarray,
    floors: np.ndarray,
    k: int,
) -> Iterator[tuple[int, int, int]]:
    """(query, id, score) of each query's k best of these vectors that reach its floor."""
    tree = BallTree(vectors)
    q = queries.astype(np.float64)
    norms = np.sqrt((q**2).sum(axis=1))
    kth = floors.astype(np.float64).copy()
    best: list[list[tuple[int, int]]] = [[] for _ in range(len(q))]
    alive = tree.bounds(0, q, norms) >= kth[:, None]
    for level, first in enumerate(tree.children, 1):
        parent = np.repeat(np.arange(len(first) - 1), np.diff(first))
        alive = alive[:, parent]
        alive &= tree.bounds(level, q, norms) >= kth[:, None]
    leaf_bounds = np.where(alive, tree.bounds(len(tree.levels) - 1, q, norms), -np.inf)
    order = np.argsort(-leaf_bounds, axis=1, kind="stable")
    ranked = np.take_along_axis(leaf_bounds, order, axis=1)
    for t in range(order.shape[1]):
        live = np.flatnonzero((ranked[:, t] >= kth) & np.isfinite(ranked[:, t]))
        if not len(live):
            break
        at = order[live, t]
        for leaf in np.unique(at):
            asked = live[at == leaf]
            a, b = tree.leaves[leaf]
            members = tree.order[a:b]
            scores = _exact(queries[asked], vectors[members])
            fit = (scores >= kth[asked, None]) & (ids[members][None, :] != query_ids[asked, None])
            for i in np.flatnonzero(fit.any(axis=1)):
                got = np.flatnonzero(fit[i])
                own = best[asked[i]]
                own += zip((-scores[i, got]).tolist(), ids[members[got]].tolist())
                own.sort()
                del own[k:]
                if len(own) == k:
                    kth[asked[i]] = max(kth[asked[i]], -own[-1][0])
    for i, own in enumerate(best):
        for negative, vec_id in own:
            yield int(query_ids[i]), vec_id, -negative


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def quantised(
    vectors: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; unusable rows are left out.

    Left out: a null id, a null or empty vector, null or non-finite components.
    """
    x = F.transform("v", lambda e: e.cast("double"))
    usable = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return (
        pick(vectors, vec_id=id_col, v=vector_col)
        .select("vec_id", x.alias("v"))
        .filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & usable)
        .select("vec_id", F.transform("v", lambda e: F.floor(e * scale)).alias("v"))
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query.

    Both tables hold (vec_id, v) with integer components. A query meets every vector of its own
    length but those with its own id; equal scores go to the smaller id. Repeated vector rows each
    count; of repeated query ids the smallest vector asks. Fewer than k candidates give all there
    are; empty tables give no rows. Scores must fit a 64-bit integer.
    """
    asked = (
        pick(queries, vec_id="vec_id", v="v")
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
    )
    sizes = vectors.agg(F.count("*")).first()[0], asked.agg(F.count("*")).first()[0]
    shards = max(32, -(-sizes[0] // SHARD_ROWS))
    blocks = max(1, -(-sizes[1] // BLOCK_QUERIES))

    pilot = (
        vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PILOT_ROWS).collect()
    )  # PILOT_ROWS vectors
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in {len(r["v"]) for r in pilot}:
        own = [r for r in pilot if len(r["v"]) == n]
        by_size[n] = (
            np.array([r["vec_id"] for r in own], np.int64),
            np.array([r["v"] for r in own], np.int64),
        )
    sent = vectors.sparkSession.sparkContext.broadcast(by_size)
    no_floor = -(2**62)

    def with_floor(batches):
        for batch in batches:
            floors = []
            for vec_id, v in zip(batch["vec_id"].to_pylist(), batch["v"].to_pylist()):
                ids, own = sent.value.get(len(v), (None, None))
                floor = no_floor
                if ids is not None:
                    scores = _exact(np.array([v], np.int64), own)[0][ids != vec_id]
                    if len(scores) >= k:
                        floor = int(np.partition(scores, -k)[-k])
                floors.append(floor)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["v"], pa.array(floors, pa.int64())],
                names=["query_id", "q", "floor"],
            )

    floored = asked.mapInArrow(with_floor, "query_id bigint, q array<bigint>, floor bigint")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select(
        F.size("v").alias("n"),
        F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"),
        spread(blocks).alias("block"),
        "vec_id",
        "v",
    )
    right = floored.select(
        F.size("q").alias("n"),
        spread(shards).alias("shard"),
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
        "query_id",
        "q",
        "floor",
    )

    def meet(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int]] = []
        if ours.num_rows and theirs.num_rows:
            rows = list(
                search(
                    ours["vec_id"].to_numpy(),
                    _matrix(ours["v"]),
                    theirs["query_id"].to_numpy(),
                    _matrix(theirs["q"]),
                    theirs["floor"].to_numpy(),
                    k,
                )
            )
        columns = zip(*rows) if rows else ([], [], [])
        return pa.table(
            [pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"]
        )

    found = (
        left.groupBy("n", "shard", "block")
        .cogroup(right.groupBy("n", "shard", "block"))
        .applyInArrow(meet, "query_id bigint, vec_id bigint, score bigint")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best).cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
