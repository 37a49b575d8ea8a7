"""Token ids in binary shards with keyed access.

Documents are range-partitioned by id and encoded in order. Each shard is one row of a written
table: the raw ids of its documents one after another, their keys in order, and an index. The
index is a minimal perfect hash of the keys (hash and displace: each bucket of keys stores the
displacement that sends its keys to free slots) with a fingerprint, an offset and a length per
slot, so that a key is found, or refused, in constant time without a search or a stored tree.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from stratastats.sources import scratch_path

from .common import pick, stream_rows

SHARD_TOKENS = 1 << 20  # a shard is closed at this many tokens
SHARD_DOCS = 8192  # or this many documents
PART_CHARS = 16 << 20  # text of one writing task, about
SLICE_CHARS = 4 << 20  # text that is encoded at a time, about
KEPT = 600_000  # encoded stretches that a worker keeps, twice

SCHEMA = (
    "part int, seq int, n_docs int, n_tokens bigint, width int, first_key bigint, last_key bigint, "
    "keys binary, first_copy int, "
    "payload binary, displacements binary, fingerprints binary, offsets binary, lengths binary"
)

# The white space of Unicode, at which byte-level pre-tokenising splits
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = "".join(re.findall(f"[{_SPACE}]", "".join(map(chr, range(0x3001)))))
_STRETCH = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
# A word of Latin letters, what stands before it, and the ASCII marks after it (no apostrophe, which
# may begin a contraction): these are pre-tokens of their own
_WORD = re.compile(
    r"( ?|\n\n?)([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02c1]+)([!-&(-/:-@\[-`{-~]*)"
)


def _stretch(key: str) -> str:
    """The text of a key: a space and the key, or the key if a line end begins it, or what follows its space."""
    return key[1:] if key[:1] == " " else key if key[:1] == "\n" else " " + key


class Encoder:
    """A tokenizer file of the tokenizers library.

    With plain byte-level pre-tokenising, no token crosses from a character into the white space
    after it, so a text is encoded in stretches, of which the frequent ones are remembered. In a
    stretch that is not remembered the word and the marks around it are looked up on their own; as
    pre-tokens by themselves they go to the tokenizer's model without its pattern.
    Other tokenizers, and texts that hold one of the added tokens, are encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        spec = json.loads(self.model.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_stretch = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not spec.get("truncation")
        )
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.code = np.dtype(f"<u{self.width}"), "H" if self.width == 2 else "I"
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        if self.by_stretch:
            self.single = Tokenizer(self.model.model)  # for one pre-token at a time
            self.single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.line_end = self._whole(["\n"])[0]

    def _whole(self, texts: list[str], model=None) -> list[bytes]:
        found = (model or self.model).encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def _new(self, keys: dict[str, None]) -> dict[str, bytes]:
        """The ids of keys that are not known, and of the words and marks in them."""
        known, before = self.known, self.before
        new, others, single, rest, parts = {}, [], {}, [], []
        for key in keys:
            ids = before.get(key)
            if ids is not None:
                new[key] = ids
                continue
            match = _WORD.fullmatch(_stretch(key))
            if match is None:
                others.append(key)
                continue
            lead, word, marks = match.groups()
            if lead != " ":
                word = " " + word
            if word == key:
                single[key] = None
                continue
            rest.append(key)
            parts.append((b"" if lead == " " else self.line_end * len(lead), word, " " + marks))
        for _, *both in parts:
            for part in both:
                if part not in single and part not in new:
                    ids = known.get(part) or before.get(part)
                    if ids is None:
                        single[part] = None
                    else:
                        new[part] = ids
        if single:
            new.update(zip(single, self._whole(list(map(_stretch, single)), self.single)))
        if others:
            new.update(zip(others, self._whole(list(map(_stretch, others)))))
        for key, (lines, word, marks) in zip(rest, parts):
            new[key] = lines + new[word] + new[marks]
        return new

    def _known(self, keys: list[str]) -> list[bytes]:
        """The ids of each key; those that are new go to the tokenizer together."""
        found = list(map(self.known.get, keys))
        if None in found:
            new = self._new(dict.fromkeys(k for k, ids in zip(keys, found) if ids is None))
            found = [new[k] if ids is None else ids for k, ids in zip(keys, found)]
            if len(self.known) >= KEPT:
                self.before, self.known = self.known, {}
            self.known.update((k, ids) for k, ids in new.items() if len(k) <= 64)
        return found

    def _joined(self, cut: pa.ListArray) -> list[bytes]:
        """The ids of each list of keys, one after another; a key is looked up once."""
        indexed = cut.values.dictionary_encode()
        ids = pa.array(self._known(indexed.dictionary.to_pylist()), pa.large_binary())
        ids = ids.take(indexed.indices)
        data = ids.buffers()[2]
        at = np.frombuffer(ids.buffers()[1], np.int64)[cut.offsets.to_numpy()]
        data = data.to_pybytes() if data else b""
        return [data[i:j] for i, j in zip(at.tolist(), at[1:].tolist())]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text.

        Texts are cut before spaces and line ends. That is right where a character stands before the
        cut, or nothing but one space after it; texts in which it is not are cut by pattern.
        """
        out: list[bytes] = [b""] * len(texts)
        whole, mixed, plain, lines, ends = [], [], [], [], []
        for i, text in enumerate(texts):
            if not self.by_stretch or any(a in text for a in self.added):
                whole.append(i)
            elif text:
                body = text.rstrip(_SPACES)
                if not body or body[0] in _SPACES:
                    mixed.append(i)
                    continue
                # a line end more at the start, which is taken off again
                line = ("\n" + body).replace("\n", " \n")
                plain.append(i)
                lines.append((line.replace(" \n \n", " \n\n") if "\n\n" in body else line)[1:])
                ends.append(text[len(body) :])
        if whole:
            for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
                out[i] = ids
        if plain:
            cut = pa.array(lines, pa.large_string())
            amid = pc.match_substring_regex(cut, f"[{_SPACES}] ").to_pylist()
            if any(amid):
                mixed += [i for i, a in zip(plain, amid) if a]
                plain, ends = ([x for x, a in zip(of, amid) if not a] for of in (plain, ends))
                cut = cut.filter(pc.invert(pa.array(amid)))
            skip = len(self.line_end)
            after = self._known([" " + e for e in ends])
            for i, ids, end in zip(plain, self._joined(pc.split_pattern(cut, " ")), after):
                out[i] = ids[skip:] + end
        if mixed:
            keys = [[" " + s for s in _STRETCH.findall(texts[i])] for i in mixed]
            for i, ids in zip(mixed, self._joined(pa.array(keys, pa.list_(pa.large_string())))):
                out[i] = ids
        return out


_LOADED: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(keys: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """64 bits of (key, which of the documents with this key)."""
    return _mixed(_mixed(keys.view(np.uint64)) + copies.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _slot(h: np.ndarray, d: np.ndarray | np.uint64, n: int) -> np.ndarray:
    return (_mixed(h + d * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(n)).astype(np.int64)


def perfect_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacement of each bucket, slot of each key) for distinct hashes; n slots for n keys.

    A bucket of one key stores its slot, as -1 - slot; larger buckets, which go first, store the
    number that sends all their keys to free slots.
    """
    n = len(h)
    buckets = max(1, n // 3)
    of = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(buckets + 1))
    sizes = np.diff(bounds)
    displacements, slots = np.zeros(buckets, np.int32), np.zeros(n, np.int64)
    free = np.ones(n, bool)
    tries = np.arange(64, dtype=np.uint64)
    for b in np.argsort(-sizes, kind="stable"):
        own = order[bounds[b] : bounds[b + 1]]
        if len(own) < 2:
            break
        first = np.uint64(0)
        while True:
            at = _slot(h[own][None, :], (first + tries)[:, None], n)
            spread = np.sort(at, axis=1)
            good = free[at].all(axis=1) & (np.diff(spread, axis=1) > 0).all(axis=1)
            if good.any():
                i = int(np.argmax(good))
                displacements[b], slots[own] = int(first) + i, at[i]
                free[at[i]] = False
                break
            first += np.uint64(64)
    single = np.flatnonzero(sizes == 1)
    left = np.flatnonzero(free)[: len(single)]
    displacements[single] = -1 - left
    slots[order[bounds[single]]] = left
    return displacements, slots


class Shard:
    """One row of the store, opened."""

    def __init__(self, row: dict):
        self.n = row["n_docs"]
        self.displacements = np.frombuffer(row["displacements"], np.int32)
        self.fingerprints = np.frombuffer(row["fingerprints"], np.uint32)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.ids = np.frombuffer(row["payload"], np.dtype(f"<u{row['width']}"))
        self.keys = np.frombuffer(row["keys"], np.int64)
        self.first_copy = row["first_copy"]

    def find(self, keys: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """The slots of keys; -1 where the fingerprint says that a key is not here."""
        h = _hashes(keys, copies)
        d = self.displacements[(h % np.uint64(len(self.displacements))).astype(np.int64)]
        slot = np.where(d < 0, -1 - d.astype(np.int64), _slot(h, d.astype(np.uint64), self.n))
        return np.where(self.fingerprints[slot] == (h >> np.uint64(32)).astype(np.uint32), slot, -1)

    def get(self, key: int, copy: int = 0) -> np.ndarray | None:
        slot = int(self.find(np.array([key], np.int64), np.array([copy]))[0])
        if slot < 0:
            return None
        return self.ids[self.offsets[slot] : self.offsets[slot] + self.lengths[slot]]


NO_ID = -(2**63)  # the key of a null id


def _copies(keys: np.ndarray, before: tuple[int, int]) -> np.ndarray:
    """For keys in order, how many equal ones stand before each; before: those of earlier shards."""
    starts = np.concatenate(([True], keys[1:] != keys[:-1]))
    first = np.flatnonzero(starts)[np.cumsum(starts) - 1]
    copies = np.arange(len(keys)) - first
    return copies + np.where(keys == before[0], before[1], 0)


def _packed(part: int, seq: int, keys: list, texts: list[bytes], width: int, before) -> tuple:
    k = np.array(keys, np.int64)
    lengths = np.array([len(t) // width for t in texts], np.int64)
    offsets = np.cumsum(lengths) - lengths
    copies = _copies(k, before)
    h = _hashes(k, copies)
    displacements, slots = perfect_hash(h)
    n = len(k)
    by_slot = [np.zeros(n, x) for x in (np.uint32, np.int64, np.int64)]
    for array, values in zip(by_slot, ((h >> np.uint64(32)).astype(np.uint32), offsets, lengths)):
        array[slots] = values
    # the first copy of the first key, for shards that begin amid equal keys
    return (
        part, seq, n, int(lengths.sum()), width, keys[0], keys[-1], k.tobytes(), int(copies[0]), b"".join(texts),
        displacements.tobytes(), *(a.tobytes() for a in by_slot),
    )


def _slices(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows that are encoded together: texts of about SLICE_CHARS."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[2] or "") + 64
        if size >= SLICE_CHARS:
            yield out
            out, size = [], 0
    if out:
        yield out


def write(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> str:
    """Encode every text, append ``end_id``, and write the shards; returns their folder.

    Shards follow the ids in ascending order, null ids first, repeated ids by a hash of the text.
    A null text is an empty one and gives the end id alone. A document longer than a shard has one
    to itself. An empty table writes an empty store.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    rows = pick(docs, id=id_col, text=text_col)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // PART_CHARS))
    ordered = (
        rows.select(F.coalesce("id", F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("body"), "text")
        .repartitionByRange(parts, "key", "body")
        .sortWithinPartitions("key", "body")
    )

    def shards(docs_in: Iterator[tuple]) -> Iterator[tuple]:
        model = _encoder(tokenizer)
        end = np.array([end_id], model.kind).tobytes()
        part, seq, keys, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        before = (0, 0)

        def close():
            nonlocal seq, keys, texts, size, before
            row = _packed(part, seq, keys, texts, model.width, before)
            same = len(keys) - keys.index(keys[-1])
            before = (keys[-1], same + (before[1] if before[0] == keys[-1] and same == len(keys) else 0))
            seq, keys, texts, size = seq + 1, [], [], 0
            return row

        for slice_ in _slices(docs_in):
            encoded = model.encode_all([text or "" for _, _, text in slice_])
            for (key, _, _), ids in zip(slice_, encoded):
                ids += end
                keys.append(key)
                texts.append(ids)
                size += len(ids) // model.width
                if size >= SHARD_TOKENS or len(keys) >= SHARD_DOCS:
                    yield close()
        if keys:
            yield close()

    stream_rows(ordered, shards, SCHEMA, batch_rows=64).write.parquet(path)
    return path


def read(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def entries(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    Each key goes through the index of its shard; ``start`` counts the ids of all documents before.
    """
    store = read(spark, path)

    def look_up(rows: Iterator[tuple]) -> Iterator[tuple]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for row in rows:
            shard = Shard(dict(zip(names, row)))
            k = shard.keys
            copies = _copies(k, (int(k[0]), shard.first_copy))
            slots = shard.find(k, copies)
            if (slots < 0).any():
                raise ValueError("a key is missing from the index of its shard")
            for key, slot in zip(k.tolist(), slots.tolist()):
                at, n = int(shard.offsets[slot]), int(shard.lengths[slot])
                crc = zlib.crc32(shard.ids[at : at + n].astype("<u4").tobytes())
                yield row[0], row[1], None if key == NO_ID else key, at, n, crc

    found = stream_rows(
        store, look_up, "part int, seq int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
    )
    sizes = store.select("part", "seq", "n_tokens")
    by_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = by_part.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead")
    )  # one row per writing task
    begins = sizes.join(ahead, "part").select(
        "part",
        "seq",
        (
            F.col("ahead")
            + F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq"))
            - F.col("n_tokens")
        ).alias("begin"),
    )
    return found.join(begins, ["part", "seq"]).select(
        "doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def shards_of(spark, path: str, keys: list[int]) -> DataFrame:
    """The shards whose range of keys holds one of ``keys``; the range reaches the Parquet scan, so
    that the payload of other shards is not read."""
    store = read(spark, path)
    near = [F.lit(k).between(F.col("first_key"), F.col("last_key")) for k in sorted(set(keys))]
    return store.filter(reduce(or_, near, F.lit(False)))


def get(spark, path: str, keys: list[int]) -> dict[int, list[int]]:
    """The ids of a few documents by key, the first copy of a repeated one."""
    wanted = np.array(sorted(set(keys)), np.int64)

    def look(rows: Iterator[tuple]) -> Iterator[tuple]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for row in rows:
            shard = Shard(dict(zip(names, row)))
            near = wanted[(wanted >= shard.keys[0]) & (wanted <= shard.keys[-1])]
            for key in near.tolist():
                ids = shard.get(key)
                if ids is not None:
                    yield key, ids.astype(np.int64).tolist()

    rows = stream_rows(shards_of(spark, path, keys), look, "key bigint, ids array<bigint>").collect()
    return {r["key"]: r["ids"] for r in rows}
