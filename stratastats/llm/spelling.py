"""Spelling variants: words one edit apart, found by partition-and-enumerate signatures.

A word's letters are a multiset, seen as a binary vector: the k-th copy of a letter is one
dimension. One letter inserted or deleted moves that vector by a Hamming distance of one, one
letter replaced by two. PartEnum makes signatures that vectors so close must share: dimensions
fall into parts, and a signature holds all but as many parts as the distance allows, so at least
one choice of left-out parts covers the difference. Words of one length meet on two of four
parts, words whose lengths differ by one on one of two.

An edit also leaves one half of a word as it is. The join key is therefore a signature together
with the letters at one end (half of the longer word), which tells apart the many words that
share a multiset. Equal keys make candidates, the edit distance decides.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import written
from .common import map_rows, pick, stream_rows

SAME_PARTS, NEXT_PARTS = 4, 2  # parts for Hamming distances 2 and 1
FLUSH_WORDS = 200_000  # counts that a worker holds
SLICE_BYTES = 1 << 20
MOST_STEPS = 6  # doublings of a chain of forms; see ``variants``

# Latin letters in lower case, everything else a blank
_LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20
    for c in range(256)
)


def _runs(text: str) -> Iterator[list[bytes]]:
    """The lower-cased letter runs of a text as Latin-1, a bounded slice of it at a time."""
    data = text.encode("latin-1", "replace").translate(_LETTERS)
    at = 0
    while at < len(data):
        cut = data.find(b" ", at + SLICE_BYTES)  # a run is never cut
        cut = len(data) if cut < 0 else cut
        yield data[at:cut].split()
        at = cut


def _misspelt(run: bytes, before: int, every: int) -> bytes:
    """``run`` without one letter, where the checksum says so."""
    text = run if run.isascii() else run.decode("latin-1").encode()
    h = zlib.crc32(text, before)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counted_words(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = 7,
    min_count: int = 2,
    misspell: int | None = None,
) -> DataFrame:
    """(word, n): the distinct letter runs of all texts with their number of occurrences.

    A run is a maximal sequence of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased; kept are
    those of ``min_length`` letters and ``min_count`` occurrences. ``misspell`` plants errors:
    a run loses the letter at ``h % length`` if h, the crc32 of ``<id>:<run>``, divides by it (a
    null id counts as empty). A null text has no runs; repeated rows each count; an empty table
    gives no rows. Workers add up before anything is shuffled.
    """

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        total: Counter[bytes] = Counter()
        for doc_id, text in rows:
            before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for runs in _runs(text or ""):
                for run, n in Counter(runs).items():
                    word = _misspelt(run, before, misspell) if misspell else run
                    if len(word) >= min_length:
                        total[word] += n
            if len(total) >= FLUSH_WORDS:
                yield from ((w.decode("latin-1"), n) for w, n in total.items())
                total.clear()
        yield from ((w.decode("latin-1"), n) for w, n in total.items())

    parts = stream_rows(
        pick(docs, doc_id=id_col, text=text_col), count, "word string, n bigint", 65536
    )
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _signatures(word: str) -> Iterator[tuple[str, bool]]:
    """(key, same): what this word shares with any word one edit away.

    ``same`` keys join words of one length, the others words whose lengths differ by one.
    """
    same: list[list[str]] = [[] for _ in range(SAME_PARTS)]
    other: list[list[str]] = [[] for _ in range(NEXT_PARTS)]
    seen: Counter[str] = Counter()
    for letter in sorted(word):
        copy, seen[letter] = seen[letter], seen[letter] + 1
        same[(ord(letter) + copy) % SAME_PARTS].append(letter)
        other[(ord(letter) // 2 + copy) % NEXT_PARTS].append(letter)
    for longer, parts, left_out in (
        (len(word), same, 2),
        (len(word), other, 1),
        (len(word) + 1, other, 1),
    ):
        half = longer // 2
        for kept in combinations(range(len(parts)), len(parts) - left_out):
            held = " ".join("".join(parts[i]) for i in kept)
            head = f"{longer} {left_out} {kept} {held}"
            yield f"{head} <{word[:half]}", left_out == 2
            yield f"{head} >{word[len(word) - half:]}", left_out == 2


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every two words one inserted, deleted or replaced letter apart.

    ``words`` holds distinct (word, n); both directions are returned, each once. Keys are hashed
    to 64 bits: a collision adds a candidate, none is lost. Null words take no part. Words
    shorter than two letters have an empty half, so a vocabulary of those only meets on the
    signature.
    """

    def keys(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"word": [], "n": [], "key": [], "same": []}
        for word, n in zip(c["word"], c["n"]):
            for key, same in _signatures(word):
                out["word"].append(word)
                out["n"].append(n)
                out["key"].append(key)
                out["same"].append(same)
        return out

    known = words.filter(F.col("word").isNotNull()).select("word", "n")
    found = map_rows(known, keys, "word string, n bigint, key string, same boolean")
    found = written(
        found.select("word", "n", F.xxhash64("key").alias("key"), "same"), "signatures"
    )
    # In one class both words are of one length, in the other the second is one letter shorter
    first, second = found.alias("a"), found.alias("b")
    one_way = F.when(F.col("a.same"), F.col("a.word") < F.col("b.word")).otherwise(
        F.length("a.word") > F.length("b.word")
    )
    pairs = (
        first.join(
            second,
            (F.col("a.key") == F.col("b.key"))
            & (F.col("a.same") == F.col("b.same"))
            & one_way
            & (F.levenshtein("a.word", "b.word", 1) == 1),
        )
        .select(
            F.col("a.word").alias("u"), F.col("a.n").alias("u_n"),
            F.col("b.word").alias("v"), F.col("b.n").alias("v_n"),
        )
        .distinct()
    )
    both = F.array(
        F.struct(F.col("u").alias("word"), F.col("v").alias("near"), F.col("v_n").alias("near_n")),
        F.struct(F.col("v").alias("word"), F.col("u").alias("near"), F.col("u_n").alias("near_n")),
    )
    return pairs.select(F.inline(both))


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of the distinct (word, n).

    ``form`` is the near word of largest n (ties: the smallest in code-point order), if that is
    at least ``times`` the word's own n; ``root`` is where the forms lead, the word itself if it
    has none. ``times`` must be at least 2: counts then grow along a chain at least twofold, so
    one of 64-bit counts has at most 62 steps, and six doublings reach every end. Words without
    a near word have null ``form`` and ``form_n``. An empty vocabulary gives no rows.
    """
    if times < 2:
        raise ValueError("times must be at least 2")
    words = written(words.select("word", "n"), "words")
    best = (
        near_pairs(words)
        .groupBy("word")
        .agg(
            F.count("*").alias("n_near"),
            F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("_best"),
        )
    )
    enough = -F.col("_best.minus") >= times * F.col("n")
    formed = written(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(enough, F.col("_best.near")).alias("form"),
            F.when(enough, -F.col("_best.minus")).alias("form_n"),
        ),
        "forms",
    )
    # Only words with a form move on; each round doubles the steps taken
    links = formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(MOST_STEPS):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = written(
            links.join(ahead, "root", "left").select(
                "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
            ),
            "roots",
        )
        links = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            break
    return formed.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
