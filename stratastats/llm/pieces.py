"""SentencePiece (byte-pair) encoding by a prefix table, and decoding.

For every prefix of a text exactly one token can end it. Tokens that end at a position come from
one automaton over the vocabulary; the one that fits is the one whose pair with the last token of
the prefix before it encodes to just that pair. The table of last tokens is filled from left to
right, and the ids are read from it backwards. No merge queue over the text is needed.

No piece has the space mark after another character, nor a line end, so a text falls into
independent stretches (a run of marks and what follows it); those that repeat are kept in a
bounded table per worker.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import SLICE_ROWS, map_rows, pick

MARK = "▁"
KEPT = 200_000  # entries of each table that a worker keeps
_NEVER = math.inf
_STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    """A byte-pair SentencePiece model with byte fallback, read from its file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.rank: dict[str, float] = {}
        self.byte_ids = [0] * 256
        own = []
        kind = np.zeros(len(self.pieces), np.uint8)  # 1: a raw byte, 2: unknown, 3: control
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                value, kind[i] = int(piece[3:5], 16), 1
                self.byte_ids[value] = i
                own.append(bytes([value]))
            elif model.is_control(i):
                kind[i] = 3
                own.append(b"")
            elif model.is_unknown(i):
                kind[i] = 2
                own.append(" ⁇ ".encode())
            else:
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    raise ValueError(f"piece {i} does not keep to one stretch")
                self.rank[piece] = -model.get_score(i)
                own.append(piece.replace(MARK, " ").encode())
        self.kind = kind
        self.lengths = np.array([len(x) for x in own])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(own) + b"\0", np.uint8)
        automaton = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            if piece in self.rank and not kind[i] and self.merged(piece) == [piece]:
                automaton.add_word(piece, (len(piece), i))
        automaton.make_automaton()
        self.automaton = automaton
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}  # words of late
        self.before: dict[str, bytes] = {}  # and of the time before
        self.parts: tuple[dict[str, bytes], ...] = ({}, {})  # without and with a mark
        self.joined = {x[i : i + 2] for x in self.rank for i in range(len(x) - 1)}

    def merged(self, text: str) -> list[str]:
        """The definition, for a few characters: merge the best pair, leftmost first."""
        parts, rank = list(text), self.rank.get
        ranks = [rank(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], _NEVER)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], _NEVER)
        return parts

    def _fits(self, key: int) -> bool:
        """Whether the pair of tokens encodes to just that pair."""
        left, right = self.pieces[key >> 20], self.pieces[key & 0xFFFFF]
        if len(self.pairs) >= KEPT:
            self.pairs.clear()
        fit = self.pairs[key] = self.merged(left + right) == [left, right]
        return fit

    def tokens(self, text: str) -> list[int]:
        """Ids of one stretch; -1 for a character without a piece."""
        last = [-1] * (len(text) + 1)  # of every prefix, the id that ends it
        sizes = [1] * (len(text) + 1)
        filled, pair, fits = -1, self.pairs.get, self._fits
        for end, (size, i) in self.automaton.iter(text):  # longest first at every end
            if end == filled:
                continue
            before = last[end + 1 - size]
            if before >= 0:
                key = (before << 20) | i
                fit = pair(key)
                if fit is None:
                    fit = fits(key)
                if not fit:
                    continue
            filled = end
            last[end + 1] = i
            sizes[end + 1] = size
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= sizes[at]
        out.reverse()
        return out

    def _stretch(self, text: str) -> bytes:
        ids = self.tokens(text)
        if -1 in ids:
            full: list[int] = []
            at = 0
            for i in ids:
                if i < 0:
                    full += [self.byte_ids[b] for b in text[at].encode("utf-8", "replace")]
                    at += 1
                else:
                    full.append(i)
                    at += len(self.pieces[i])
            ids = full
        return array("I", ids).tobytes()

    def _word(self, word: str) -> bytes:
        """A word after one space, or one that begins with a line end; not met lately."""
        ids = self.before.get(word)
        if ids is None:
            joined, cut, ids = self.joined, 0, b""
            marked = word[0] != "\n"
            for at in range(1, len(word)):
                if word[at - 1 : at + 1] not in joined:  # no piece spans these two
                    ids += self._part(word[cut:at], marked and not cut)
                    cut = at
            ids += self._part(word[cut:], marked and not cut)
        if len(word) <= 64:
            if len(self.known) >= KEPT:
                self.before, self.known = self.known, {}
            self.known[word] = ids
        return ids

    def _part(self, part: str, marked: bool) -> bytes:
        table = self.parts[marked]
        ids = table.get(part)
        if ids is None:
            ids = self._stretch(MARK + part if marked else part)
            if len(part) <= 64:
                if len(table) >= KEPT:
                    table.clear()
                table[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids, without begin and end."""
        if not text:
            return b""
        if (
            text[0] in " \n"
            or text[-1] == " "
            or "  " in text
            or " \n" in text
            or MARK in text
        ):  # runs of marks
            spaced = MARK + text.replace(" ", MARK)
            return b"".join([self._stretch(x) for x in _STRETCH.findall(spaced)])
        words = text.replace("\n", " \n").split(" ")
        out = list(map(self.known.get, words))
        try:
            return b"".join(out)
        except TypeError:  # words not met before
            for i, ids in enumerate(out):
                if ids is None:
                    out[i] = self._word(words[i])
            return b"".join(out)

    def decode(self, ids: array) -> str:
        """The text of ids; broken byte sequences become replacement characters, one per byte."""
        i = np.frombuffer(ids, np.uint32)
        kind = self.kind[i]
        high = (kind == 1) & (self.bytes[self.starts[i]] >= 0x80)  # others are characters
        if not high.any():
            text = self._joined(i).decode()
        else:
            edges = np.flatnonzero(np.diff(high)) + 1
            text = "".join(
                [
                    _lenient(raw) if high[at] else raw.decode()
                    for at, part in zip([0, *edges.tolist()], np.split(i, edges))
                    for raw in (self._joined(part),)
                ]
            )
        shown = np.flatnonzero(kind != 3)
        if len(shown) and not kind[shown[0]] and text.startswith(" "):
            return text[1:]  # the mark that encoding puts in front
        return text

    def _joined(self, i: np.ndarray) -> bytes:
        sizes = self.lengths[i]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        shift = np.repeat(self.starts[i] - ends + sizes, sizes)
        return self.bytes[shift + np.arange(ends[-1])].tobytes()


def _lenient(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", check: bool = False
) -> DataFrame:
    """(doc_id, ids) for every row: begin id, the text's ids, end id.

    ``check`` decodes the ids again and adds decoded_sha256, the digest of that text. A null text is
    an empty one: begin and end only. Very long texts are worked off stretch by stretch. Null and
    repeated ids are kept as they are.
    """

    def run(batches):
        p = loaded(model)
        first, last = array("I", [p.begin]).tobytes(), array("I", [p.end]).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                raw = [first + p.encode(t or "") + last for t in batch["text"].to_pylist()]
                ends = np.cumsum([0] + [len(x) // 4 for x in raw]).astype(np.int32)
                ids = pa.array(np.frombuffer(b"".join(raw), np.int32))
                columns = [batch["id"], pa.ListArray.from_arrays(pa.array(ends), ids)]
                if check:
                    decoded = (p.decode(array("I", x)).encode() for x in raw)
                    columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id bigint, ids array<int>" + ", decoded_sha256 string" * check
    names = ["doc_id", "ids"] + ["decoded_sha256"] * check
    return pick(docs, id=id_col, text=text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of encoded rows; null ids give a null text."""

    def run(batch):
        p = loaded(model)
        texts = [None if x is None else p.decode(array("I", x)) for x in batch["ids"]]
        return {"doc_id": batch["id"], "text": texts}

    return map_rows(pick(encoded, id=id_col, ids=ids_col), run, "doc_id bigint, text string")


def digests(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encoded and decoded again in one pass: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batch):
        p = loaded(model)
        edge = array("I", [p.begin]).tobytes(), array("I", [p.end]).tobytes()
        out = {"doc_id": batch["id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in batch["text"]:
            raw = edge[0] + p.encode(text or "") + edge[1]
            ids = array("I", raw)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(p.decode(ids).encode()).hexdigest())
        return out

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_rows(pick(docs, id=id_col, text=text_col), run, schema)
