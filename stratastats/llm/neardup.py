"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of band hashes are computed per document, A and B. Every table of the index
is keyed by a pair (A_i, B_j), so that 2 x 10 bands of 4 hashes serve 100 tables of 8 hashes: 80
minhashes instead of 800. Documents with equal shingle sets are collapsed first. Only documents
that share some A_i and some B_j with another one can meet in a table; the others never expand.

Candidates are confirmed on their full shingle sets. Within a table's bucket each document first
meets one centre, then a few others, which joins most groups of copies. Small buckets that still
hold several components are compared document by document. In larger ones with few components two
documents per component are tried (others in each of the tables), which only spares work. Every
larger bucket that holds several components then is set against one pivot of its largest component:
two documents that are linked share a shingle outside the pivot, one of the rarest there of each, which
makes new buckets, or have sizes that few have, and those pairs are compared. Buckets that are still crowded after some such
rounds are compared pair by pair across components; no pair that shares a table is left out. Components come from
alternating large and small stars; later links only walk the graph of the components so far.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from stratastats.sources import written

from .common import pick, stream_rows

WORDS = 5
BANDS, ROWS = 10, 4  # of each of the two collections
SMALL = 20  # documents of a bucket that are compared pair by pair
CENTRES = 3  # further centres of a bucket before that
SPLITS = 3
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MEMO: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    A-Z count as a-z. A text of fewer words is one shingle, and without words there is none.
    """
    if not text:
        return np.empty(0, np.uint64)
    if len(_MEMO) > 200_000:
        _MEMO.clear()
    own = text.encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    hashes = list(map(_MEMO.get, own))
    for i, h in enumerate(hashes):
        if h is None:
            hashes[i] = _MEMO[own[i]] = xxhash.xxh3_64_intdigest(own[i])
    h = np.array(hashes, np.uint64)
    size = min(words, len(h))
    sums = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        sums = sums * _ODD + h[i : len(h) - size + 1 + i]
    return np.unique(_mix(sums))


_RANDOM = np.random.default_rng(97)
_FACTORS = _RANDOM.integers(0, 2**31, 2 * BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 2**32, 2 * BANDS * ROWS, dtype=np.uint32)


def bands(found: np.ndarray) -> list[int]:
    """One hash per band, first those of A, then those of B; for a set that is not empty."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint32).max, np.uint32)
    low = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 1024):
        hashed = low[None, at : at + 1024] * _FACTORS[:, None]
        hashed += _SHIFTS[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    rows = _mix(least.astype(np.uint64)).reshape(2 * BANDS, ROWS)
    total = np.zeros(2 * BANDS, np.uint64)
    for i in range(ROWS):
        total = total * _ODD + rows[:, i]
    return _mix(total).view(np.int64).tolist()


def _digest(found: np.ndarray) -> tuple[int, int]:
    raw = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8")
    return int(raw[0]), int(raw[1])


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge (u, v) leads to a root: no u has two edges, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    open_ = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not open_.filter("down > 1 or (down = 1 and up = 1)").agg(F.count("*")).first()[0]


def _stars(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that can be reached, for every node of the edges (u, v)
    but those smallest ones."""
    edges = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u <> v")
        .distinct(),
        "edges",
    )
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).unionByName(edges.join(least, "u").select("u", F.col("m").alias("v")))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        edges = written(small, "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links (u, v); only the graph of whole components is walked."""
    ends = (
        links.join(labels.select(F.col("node").alias("u"), F.col("label").alias("from")), "u", "left")
        .join(labels.select(F.col("node").alias("v"), F.col("label").alias("to")), "v", "left")
        .select(F.coalesce("from", "u").alias("u"), F.coalesce("to", "v").alias("v"))
    )
    moved = _stars(ends)
    onto = moved.select(F.col("node").alias("label"), F.col("label").alias("new"))
    kept = labels.join(onto, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    return written(kept.unionByName(moved), "labels")


def components(
    docs: DataFrame,
    percent: int = 80,
    words: int = WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for every row of ``docs``.

    Documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets.
    ``component_id`` is the smallest id that can be reached, ``kept`` says that it is the own one.
    Null and empty texts have no shingles and no links. Repeated ids are one document. A row
    with a null id is linked with nothing, has a null component and is kept.
    """
    spark = docs.sparkSession
    base = pick(docs, doc=id_col, text=text_col)

    def sign(rows):
        for doc, text in rows:
            found = shingles(text, words)
            if len(found):
                yield doc, len(found), *_digest(found), bands(found)
            else:
                yield doc, 0, None, None, None

    signed = written(
        stream_rows(base, sign, "doc bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>"),
        "signatures",
    )
    linked = signed.filter("doc is not null and n > 0")
    firsts = linked.groupBy("d1", "d2").agg(F.min("doc").alias("rep"))
    own = written(
        linked.join(written(firsts, "sets"), ["d1", "d2"]).select("doc", "n", "d1", "d2", "rep"),
        "classes",
    )
    reps = linked.join(
        own.filter("doc = rep").select("doc", "d1", "d2").distinct(), ["doc", "d1", "d2"]
    ).dropDuplicates(["doc", "d1", "d2"]).select(F.col("doc").alias("rep"), "n", "d1", "d2", "bands")

    # documents that share a band of A and one of B with others
    each = reps.select("rep", F.posexplode("bands").alias("i", "h")).select(
        "rep", "i", F.xxhash64("i", "h").alias("key")
    )
    shared = written(
        each.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "shared"
    )
    active_ids = (
        each.join(shared, "key")
        .groupBy("rep")
        .agg(F.min("i").alias("a"), F.max("i").alias("b"))
        .filter(f"a < {BANDS} and b >= {BANDS}")
        .select("rep")
    )
    active = written(reps.join(active_ids, "rep"), "active")

    ours, theirs = F.slice("bands", 1, BANDS), F.slice("bands", BANDS + 1, BANDS)
    tables = F.flatten(
        F.transform(
            ours,
            lambda x, i: F.transform(theirs, lambda y, j: F.xxhash64(i, j, x, y)),
        )
    )
    members = _crowded(active.select("rep", "n", F.explode(tables).alias("key")))

    def sets(rows):
        for doc, text, d1, d2 in rows:
            found = shingles(text, words)
            if len(found) and _digest(found) == (d1, d2):
                yield doc, found.tobytes()

    wanted = active.select(F.col("rep").alias("doc"), "d1", "d2")
    # an id with several texts has a set for each; its documents are linked below anyway
    full = written(
        stream_rows(
            base.join(wanted, "doc").select("doc", "text", "d1", "d2"), sets, "doc bigint, found binary"
        ).dropDuplicates(["doc", "found"]),
        "full",
    )

    def confirm(rows):
        for u, v, x, y in rows:
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= percent * (len(a) + len(b) - both):
                yield u, v

    def confirmed(pairs: DataFrame) -> DataFrame:
        return stream_rows(
            pairs.join(full.select(F.col("doc").alias("u"), F.col("found").alias("x")), "u")
            .join(full.select(F.col("doc").alias("v"), F.col("found").alias("y")), "v")
            .select("u", "v", "x", "y"),
            confirm,
            "u bigint, v bigint",
        )

    def place(rows):
        for core, rep, label, pivot, x, c in rows:
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(c, np.uint64)
            outer = np.setdiff1d(a, b, assume_unique=True)
            n, both = len(a), len(a) - len(outer)
            # a link covers ``percent`` of the set, so so many of its shingles lie outside the
            # pivot; one of the others, the ``first``, is then among them in any order
            least = max(1, -(-percent * n // 100) - both)
            first = max(0, len(outer) - least + 1)
            outer = outer.view(np.int64).tolist() if first else []
            longest = both * (100 + percent) // percent - n
            yield core, rep, label, pivot, n, longest, 100 * both >= percent * (n + len(b) - both), first, outer

    def against_pivots(crowd: DataFrame) -> DataFrame:
        """Each (core, rep, label) beside one document of its core, the pivot: whether they are
        ``close``, the size of the ``longest`` set that can be linked with this one without
        a common shingle outside the pivot, and the shingles ``outer`` of it, of which the ``first``
        many in an order of the core's are to look for otherwise."""
        crowd = written(crowd, "crowd")
        first = crowd.filter("label = core").groupBy("core").agg(F.min("rep").alias("pivot"))
        pivots = written(
            first.join(full.select(F.col("doc").alias("pivot"), F.col("found").alias("c")), "pivot")
            .dropDuplicates(["core"]),
            "pivots",
        )
        placed = stream_rows(
            crowd.join(full.select(F.col("doc").alias("rep"), F.col("found").alias("x")), "rep")
            .join(pivots, "core")
            .select("core", "rep", "label", "pivot", "x", "c"),
            place,
            "core bigint, rep bigint, label bigint, pivot bigint, n bigint, longest bigint,"
            " close boolean, first bigint, outer array<bigint>",
        )
        return written(placed, "placed")

    close = f"100 * least(n, m) >= {percent} * greatest(n, m)"  # sizes alone rule out the others

    # an id that stands for several sets links them
    several = own.groupBy("doc").agg(F.min("rep").alias("v"), F.max("rep").alias("top")).filter("v < top")
    same_id = own.join(several, "doc").select(F.col("rep").alias("u"), "v").filter("u <> v")

    centre = members.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("c"))
    met = (
        members.join(written(centre, "centres"), "key")
        .select("rep", "n", F.col("c.rep").alias("centre"), F.col("c.n").alias("m"))
        .filter(f"rep <> centre and {close}")
        .groupBy("rep")
        .agg(F.min("centre").alias("centre"))
    )
    tested = written(met.select(F.col("rep").alias("u"), F.col("centre").alias("v")), "tested")
    labels = _stars(confirmed(tested).unionByName(same_id))

    # more centres, one new pair a document each time: groups whose first centre is not in reach
    for turn in range(CENTRES):
        mask = F.xxhash64("key", F.lit(-1 - turn)).bitwiseAND(F.lit(2**62 - 1))
        marked = members.join(labels, F.col("rep") == F.col("node"), "left").select(
            "key", "rep", "n", F.coalesce("label", "rep").alias("label")
        )
        centre = marked.groupBy("key").agg(
            F.min(F.struct(F.col("rep").bitwiseXOR(mask).alias("turned"), "rep", "n", "label")).alias("c")
        )
        met = written(
            marked.join(centre, "key")
            .select("rep", "n", "label", F.col("c.rep").alias("v"), F.col("c.n").alias("m"), F.col("c.label").alias("other"))
            .filter(f"rep <> v and label <> other and {close}")
            .groupBy("rep")
            .agg(F.min("v").alias("v"))
            .select(F.greatest("rep", "v").alias("u"), F.least("rep", "v").alias("v"))
            .distinct()
            .join(tested, ["u", "v"], "left_anti"),
            "met",
        )
        if met.isEmpty():
            break
        labels = _joined(labels, confirmed(met))
        tested = tested.unionByName(met)

    def across(rows: DataFrame, also: str = "true") -> DataFrame:
        """Pairs of one key and different labels, of sizes that can be linked."""
        other = rows.select(
            "key",
            F.col("rep").alias("v"),
            *[F.col(c).alias("m" if c == "n" else f"{c}_") for c in rows.columns if c not in ("key", "rep")],
        )
        met = rows.join(other, "key").filter("rep > v and label <> label_")
        return met.filter(f"n is null or {close}").filter(also).select(F.col("rep").alias("u"), "v")

    def same_docs(rep: str):
        """Two sums that tell which documents a bucket holds, repeated ones included."""
        return [F.sum(F.shiftright(F.xxhash64(rep, F.lit(i)), 28)).alias(f"h{i}") for i in range(2)]

    def linked_by(pairs: DataFrame) -> DataFrame:
        """The labels after those of the pairs (u, v) that were not tested before."""
        nonlocal tested
        fresh = written(
            pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
            .join(tested, ["u", "v"], "left_anti"),
            "fresh",
        )
        if fresh.isEmpty():
            return labels
        tested = tested.unionByName(fresh)
        links = written(confirmed(fresh), "links")
        return labels if links.isEmpty() else _joined(labels, links)

    for depth in range(SPLITS + 1):
        marked = members.join(labels, F.col("rep") == F.col("node"), "left").select(
            "key", "rep", "n", F.coalesce("label", "rep").alias("label")
        )
        # two documents for each component of a bucket, others in every bucket
        mask = F.xxhash64("key", F.lit(depth)).bitwiseAND(F.lit(2**62 - 1))
        turned = F.col("rep").bitwiseXOR(mask)
        of_key = Window.partitionBy("key")
        groups = written(
            marked.groupBy("key", "label")
            .agg(F.count("*").alias("own"), F.min(turned).alias("lo"), F.max(turned).alias("hi"), *same_docs("rep"))
            .withColumns(
                {
                    "size": F.sum("own").over(of_key),
                    "parts": F.count("*").over(of_key),
                    "s0": F.sum("h0").over(of_key),
                    "s1": F.sum("h1").over(of_key),
                }
            )
            .filter("parts > 1"),
            "groups",
        )
        # of small buckets with the same documents one does for all
        small = groups.filter(F.col("size") <= SMALL).groupBy("size", "s0", "s1").agg(F.min("key").alias("key"))
        few = marked.join(small.select("key"), "key").select("key", "rep", "n", "label")
        many = (
            groups.filter((F.col("size") > SMALL) & (F.col("parts") <= SMALL // 2))
            .select("key", "label", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("rep"))
            .select("key", F.col("rep").bitwiseXOR(mask).alias("rep"), F.lit(None).cast("bigint").alias("n"), "label")
        )
        labels = linked_by(across(few).unionByName(across(many)))
        # the larger buckets, whose components were only sampled so far, as they are now; the largest
        # component is their core
        large = marked.join(groups.filter(F.col("size") > SMALL).select("key").distinct(), "key")
        left = (
            large.select("key", "rep", "n")
            .join(labels, F.col("rep") == F.col("node"), "left")
            .select("key", "rep", "n", F.coalesce("label", "rep").alias("label"))
        )
        cores = written(
            left.groupBy("key", "label")
            .agg(F.count("*").alias("own"))
            .groupBy("key")
            .agg(
                F.max(F.struct("own", (-F.col("label")).alias("least"))).alias("c"),
                F.count("*").alias("parts"),
            )
            .filter("parts > 1")
            .select("key", (-F.col("c.least")).alias("core")),
            "cores",
        )
        if cores.isEmpty():
            break
        crowd = left.join(cores, "key")
        if depth == SPLITS:
            # what is still crowded is compared pair by pair, buckets of the same documents once
            once = (
                crowd.groupBy("key")
                .agg(F.count("*").alias("c"), *same_docs("rep"))
                .groupBy("c", "h0", "h1")
                .agg(F.min("key").alias("key"))
                .select("key")
            )
            rest = written(crowd.join(once, "key").select("key", "rep", "n", "label"), "rest")
            labels = linked_by(across(rest))
            break
        placed = against_pivots(crowd.select("core", "rep", "label").distinct())
        onto = placed.filter("close and rep <> pivot").select(F.col("rep").alias("u"), F.col("pivot").alias("v"))
        if not onto.isEmpty():
            labels = _joined(labels, onto)

        # a pair that shares nothing outside its pivot: each is at most as long as the other allows
        inner = placed.withColumn("label", F.when(F.col("close"), F.col("core")).otherwise(F.col("label")))
        loose = F.when(F.col("label") != F.col("core"), F.col("longest"))
        reach = inner.groupBy("core").agg(F.min("n").alias("low"), F.max(loose).alias("high"))
        inside = written(
            inner.join(written(reach, "reach"), "core")
            .filter("longest >= low and (label <> core or n <= high)")
            .select(F.col("core").alias("key"), "rep", "n", "longest", "label"),
            "inside",
        )
        labels = linked_by(across(inside, "n <= longest_ and m <= longest"))
        # all others share a shingle outside it: one of the rarest of each, by their number in the core
        outside = placed.select("core", "rep", "n", "first", F.size("outer").alias("own"), F.explode("outer").alias("shingle"))
        often = outside.groupBy("core", "shingle").agg(F.count("*").alias("c")).filter("c > 1")
        of_rep = Window.partitionBy("core", "rep")
        rank = F.row_number().over(of_rep.orderBy("c", "shingle")) + F.col("own") - F.count("*").over(of_rep)
        rarest = outside.join(often, ["core", "shingle"]).withColumn("rank", rank).filter("rank <= first")
        members = _crowded(rarest.select(F.xxhash64("core", "shingle").alias("key"), "rep", "n"))

    result = own.join(labels, F.col("rep") == F.col("node"), "left").select(
        "doc", F.coalesce("label", "rep").alias("component")
    )
    by_doc = result.groupBy("doc").agg(F.min("component").alias("component"))
    return (
        signed.select("doc", "n")
        .join(by_doc, "doc", "left")
        .select(
            F.col("doc").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "doc").alias("component_id"),
            F.coalesce(F.col("doc") == F.coalesce("component", "doc"), F.lit(True)).alias("kept"),
        )
    )


def kept_rows(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: those kept in ``found``, the result of
    :func:`components`. Of rows that repeat an id one stays; rows without an id all stay."""
    kept = found.filter("kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col(f"`{id_col}`").alias("_doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("_body"))
    first = Window.partitionBy("_doc").orderBy("_body")
    one = (
        rows.filter("_doc is not null")
        .join(kept, F.col("_doc") == F.col("_id"))
        .withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
    )
    return one.select("_row.*").unionByName(rows.filter("_doc is null").select("_row.*"))


def _crowded(keyed: DataFrame) -> DataFrame:
    """Rows (key, rep, n) of the keys that several documents share, written once."""
    keyed = written(keyed.select("key", "rep", "n"), "keys")
    counts = keyed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    return written(keyed.join(written(counts, "crowded"), "key"), "members")
