"""Document fingerprints: I-Match with randomised lexicons.

Terms whose inverse document frequency lies in a band make the lexicon. A document's terms in the
lexicon, distinct and sorted, are hashed as a whole and again within several random subsets of the
lexicon; a small edit leaves the hashes of most subsets that it does not touch. Subsets are thinned
in powers of two, and a document uses the levels at which a subset holds a term or two of it, so
that short and long documents are compared alike.

The band is relative: a term in it occurs in at least ``exp(-idf_max)`` of the documents, so there
are at most ``exp(idf_max)`` times as many as a document has distinct terms on average, however
large the corpus. That is what is sent to the tasks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import SLICE_ROWS, pick, stream_rows

IDF_MIN, IDF_MAX = 1.0, 7.0
SUBSETS = 32  # random lexicon subsets on each level
USED = 3  # levels in a fingerprint
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_NOTHING = "0" * 16
COUNTED = 400_000  # terms that a task counts before it passes them on
KEPT = 500_000  # words whose hashes a worker keeps, twice
_NUMBERS: dict[str, int] = {}
_BEFORE: dict[str, int] = {}


def _number(word: str) -> int:
    """The hash of a word without the punctuation around it; 0 if nothing is left."""
    term = word if word.isalpha() else _EDGES.sub("", word)
    return xxhash.xxh32_intdigest(term.encode("utf-8", "surrogatepass")) | 1 if term else 0


def terms(text: str) -> set[int]:
    """Distinct terms as 32-bit hashes: words in lower case without punctuation around them."""
    global _NUMBERS, _BEFORE
    words = set(text.lower().split())
    found = set(map(_NUMBERS.get, words))
    if None in found:
        new = {}
        for w in words.difference(_NUMBERS):
            number = _BEFORE.get(w)
            new[w] = _number(w) if number is None else number
        if len(_NUMBERS) > KEPT:
            _NUMBERS, _BEFORE = {}, _NUMBERS
        _NUMBERS.update(new)
        found.discard(None)
        found.update(new.values())
    found.discard(0)
    return found


@dataclass
class Lexicon:
    terms: np.ndarray  # sorted hashes of the terms in the band

    def fingerprint(self, text: str) -> str:
        """``whole:level:hashes:hashes:hashes``: hashes on the level and on the next ones.

        Without a term in the band all terms count; without terms at all it is a constant.
        """
        found = terms(text)
        if not found:
            return f"{_NOTHING}:0" + ":" * USED
        own = np.sort(np.fromiter(found, np.uint32, len(found)))
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, own), len(self.terms) - 1)
            inside = own[self.terms[at] == own]
            own = inside if len(inside) else own
        level = max(0, round(math.log2(len(own) / 1.5)))
        whole = xxhash.xxh64_hexdigest(own.tobytes())
        return ":".join([whole, str(level), *_subset_hashes(own, level)])


_RANDOM = np.random.default_rng(20011)
_LIMITS = np.array([min(2**32 - 1, 2**32 >> deep) for deep in range(32 + USED)], np.uint32)
_GROUPS = np.arange(USED * SUBSETS + 1)
_SALTS = _RANDOM.integers(0, 2**31, SUBSETS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _subset_hashes(own: np.ndarray, level: int) -> list[str]:
    """On each level in use, 16 bits per subset as hex; 0000 where a subset holds no term.

    A subset keeps the terms whose salted hash lies below a power of two; its own hash runs over
    its sorted terms, each mixed with the sum of those before it.
    """
    x = own[None, :] * _SALTS[:, None]
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(13)
    value = own * np.uint32(0x9E3779B1)
    value ^= value >> np.uint32(16)
    value *= np.uint32(0x85EBCA77)
    # members on the first level are a term or two per subset, however long the text; the others are among them
    x = x.ravel()
    first = (x < _LIMITS[level]).nonzero()[0]
    subset, term = np.divmod(first, len(own))
    deep, member = (x[first] < _LIMITS[level : level + USED, None]).nonzero()
    group = deep * SUBSETS + subset[member]
    value = value[term[member]]
    bounds = group.searchsorted(_GROUPS)
    starts, ends = bounds[:-1], bounds[1:]
    upto = value.cumsum(dtype=np.uint32)
    mixed = (upto - (upto - value)[starts[group]]) * np.uint32(0x27D4EB2F)
    total = np.zeros(len(group) + 1, np.uint32)
    mixed.cumsum(dtype=np.uint32, out=total[1:])
    short = np.maximum((total[ends] - total[starts]) >> np.uint32(16), np.uint32(1)).astype(">u2")
    short[starts == ends] = 0
    found = short.tobytes().hex()
    return [found[i : i + 4 * SUBSETS] for i in range(0, len(found), 4 * SUBSETS)]


def likeness(a: str | None, b: str | None) -> float:
    """Share of the subsets with terms on which two fingerprints agree, 0 to 1.

    Equal fingerprints give 1. Documents of very different numbers of terms share no level and
    give 0, and so does a null.
    """
    if a is None or b is None:
        return 0.0
    if a == b:
        return 1.0
    x, y = a.split(":"), b.split(":")
    levels = dict(enumerate(x[2:], int(x[1])))
    same = told = 0
    for level, other in enumerate(y[2:], int(y[1])):
        mine = levels.get(level)
        if mine and other:
            for i in range(0, len(mine), 4):
                p, q = mine[i : i + 4], other[i : i + 4]
                if p != "0000" or q != "0000":
                    told += 1
                    same += p == q
    return same / told if told else 0.0


def lexicon(
    docs: DataFrame,
    text_col: str = "text",
    idf_min: float = IDF_MIN,
    idf_max: float = IDF_MAX,
) -> Lexicon:
    """Document frequencies over all rows; the terms with ``idf_min <= ln(N/df) <= idf_max``."""

    def packed(sums: Counter) -> pa.RecordBatch:
        found = np.fromiter(sums.keys(), np.int64, len(sums)) - 2**31
        n = np.fromiter(sums.values(), np.int32, len(sums))
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n)], ["term", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for text in batch.column(0).slice(at, SLICE_ROWS).to_pylist():
                    sums.update(terms(text))
                    if len(sums) >= COUNTED:
                        yield packed(sums)
                        sums = Counter()
        if sums:
            yield packed(sums)

    rows = pick(docs, text=text_col)
    n = rows.count()
    if not n:
        return Lexicon(np.empty(0, np.uint32))
    counted = rows.filter("text is not null").mapInArrow(count, "term int, n int")
    idf = F.log(F.lit(float(n)) / F.col("df"))
    band = (
        counted.groupBy("term")
        .agg(F.sum("n").alias("df"))
        .filter((idf >= idf_min) & (idf <= idf_max))
        .select("term")
    )  # bounded: see above
    found = np.array([r[0] for r in band.toLocalIterator()], np.int64) + 2**31
    return Lexicon(np.sort(found.astype(np.uint32)))


def fingerprints(docs: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; a null text is an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(lex)

    def run(rows):
        for doc_id, text in rows:
            yield doc_id, sent.value.fingerprint(text or "")

    return stream_rows(pick(docs, id=id_col, text=text_col), run, "doc_id bigint, fingerprint string")


NO_ID = -(2**63)  # stands for a null id, before all others
BLOCK_CHARS, MAX_BLOCKS = 4 << 20, 20_000


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (block, guest, key, text), dealt by block and sorted: each row's next is its successor.

    Documents fall into blocks of consecutive ids; the first document of a block is also the last
    row, marked as a guest, of the block before it, and that of the first block of the last.
    Null ids come first; repeated ids follow a hash of their texts.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    keyed = pick(docs, id=id_col, text=text_col).select(
        F.coalesce("id", F.lit(NO_ID)).alias("key"), "text"
    ).withColumn("place", F.col("key").cast("double"))
    chars = keyed.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(min(MAX_BLOCKS, -(-chars // BLOCK_CHARS) or 1))
    cuts = sorted(set(keyed.approxQuantile("place", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    edges = [-math.inf, *[c for c in cuts if c > float(NO_ID)], math.inf]
    blocks = Bucketizer(splits=edges, inputCol="place", outputCol="block") if len(edges) > 2 else None
    placed = (blocks.transform(keyed) if blocks else keyed.withColumn("block", F.lit(0.0))).select(
        F.col("block").cast("int").alias("block"), "key", F.xxhash64("text").alias("body"), "text"
    )
    firsts = sorted(
        (r["block"], r["first"]["key"], r["first"]["body"])
        for r in placed.groupBy("block").agg(F.min(F.struct("key", "body")).alias("first")).collect()
    )  # a row per block
    before = [(b, k, h, firsts[i - 1][0]) for i, (b, k, h) in enumerate(firsts)]
    schema = "block int, key bigint, body bigint, guest_of int"
    heads = F.broadcast(spark.createDataFrame(before, schema))
    guests = (
        placed.join(heads, ["block", "key", "body"])
        .select("guest_of", "block", "key", "body", "text")
        .dropDuplicates(["block"])
        .select(F.col("guest_of").alias("block"), F.lit(1).alias("guest"), "key", "body", "text")
    )
    own = placed.select("block", F.lit(0).alias("guest"), "key", "body", "text")
    return (
        own.unionByName(guests)
        .repartition(max(1, len(firsts)), "block")
        .sortWithinPartitions("block", "guest", "key", "body")
    )


def edited_digests(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likenesses.

    The edited text has its last quarter of code points replaced by as many from the start of the
    next document in the order of ids (all, if it has fewer; the first document follows the last).
    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    """
    import hashlib

    sent = docs.sparkSession.sparkContext.broadcast(lex)

    def run(rows):
        last = None
        for block, guest, key, _, text in rows:
            text = text or ""
            print_ = sent.value.fingerprint(text)
            if last is not None and last[0] == block:
                _, before, own, own_print = last
                part = len(own) // 4
                edited = own[: len(own) - part] + text[:part]
                edited_print = sent.value.fingerprint(edited) if edited != own else own_print
                yield (
                    None if before == NO_ID else before,
                    len(own),
                    hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                    own_print,
                    edited_print,
                    likeness(own_print, edited_print),
                    likeness(own_print, print_),
                )
            last = None if guest else (block, key, text, print_)

    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    return stream_rows(with_next(docs), run, schema)
