"""Line deduplication by range partitioning and streaming.

Lines long enough become rows (hash of the key, document, position). They are range-partitioned
on hash and document together, so that one very common line spreads over many tasks, and sorted
by hash, then document from the largest down, then position. A stream over each partition meets
the document that keeps a line first and decides all later ones. Only the runs at a partition's
edges may go on elsewhere: their rows stay open until the counts of their parts are added up.
The result is a compressed bitmap of kept lines per document; texts never enter this shuffle.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from stratastats.sources import written

from .common import SLICE_ROWS, map_rows, pick, stream_rows

SPACE = " \t\n\v\f\r"
_NO_ID = -(2**63)  # stands for a null id, before all others
_SIGN = 1 << 64


def _signed(x: int) -> int:
    return x - _SIGN if x >= _SIGN >> 1 else x


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a key of their own: the id (nulls share one) and a hash of the text."""
    return pick(docs, doc_id=id_col, text=text_col).select(
        "doc_id",
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"),
        F.xxhash64("text").alias("body"),
        "text",
    )


def keep_bitmaps(
    docs: DataFrame,
    min_chars: int = 40,
    min_docs: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc, body, n_dropped, keep): one row for each document that loses lines.

    A line's key is the line without white space at its ends and with A-Z in lower case. Keys of
    ``min_chars`` code points or more in ``min_docs`` documents or more keep their lines in the
    largest document only. ``keep`` is a zlib-packed bitmap, one bit per line; lines after its end
    stay. Rows that share an id count as one document; null ids are one document before all
    others. Null and empty texts, empty tables and texts without long lines give no rows.
    """

    def lines(rows):
        for doc, body, text in rows:
            if text is None or len(text) < min_chars:
                continue
            for pos, line in enumerate(text.split("\n")):
                if len(line) >= min_chars:
                    key = line.strip(SPACE)
                    if len(key) >= min_chars:
                        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass").lower())
                        yield _signed(h >> 64), _signed(h & (_SIGN - 1)), doc, body, pos

    def stream(rows):
        """kind 0: a line to drop; 1: an open line; 2: (documents, largest) of an edge run."""
        key = first = None
        docs_in = 0
        largest = None
        held: list[tuple] = []
        doc = None

        def close(last: bool):
            if key is None:
                return
            if first or last:
                for d, b, p in held:
                    yield 1, *key, d, b, p, None
                yield 2, *key, largest, None, None, docs_in

        for h1, h2, d, body, pos in rows:
            if (h1, h2) != key:
                yield from close(False)
                first = key is None
                key, docs_in, largest, doc, held = (h1, h2), 0, d, None, []
            if d != doc:
                docs_in, doc = docs_in + 1, d
                if docs_in == min_docs and not first:
                    for row in held:
                        yield 0, *key, *row, None
                    held = []
            if first:
                yield 1, *key, d, body, pos, None  # it may have begun in an earlier partition
            elif d != largest:
                if docs_in >= min_docs:
                    yield 0, *key, d, body, pos, None
                else:
                    held.append((d, body, pos))
        yield from close(True)

    rows = stream_rows(
        _keyed(docs, id_col, text_col).select("doc", "body", "text"),
        lines,
        "h1 bigint, h2 bigint, doc bigint, body bigint, pos int",
        batch_rows=32768,
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "h1", "h2", F.desc("doc")).sortWithinPartitions(
        "h1", "h2", F.desc("doc"), "body", "pos"
    )
    decided = written(
        stream_rows(
            ordered,
            stream,
            "kind int, h1 bigint, h2 bigint, doc bigint, body bigint, pos int, n bigint",
            batch_rows=32768,
        ),
        "lines",
    )  # read twice; a range partitioning made anew could cut elsewhere
    edges = (
        decided.filter("kind = 2")
        .groupBy("h1", "h2")
        .agg(F.sum("n").alias("total"), F.max("doc").alias("largest"))
        .filter(F.col("total") >= min_docs)
    )
    closed = (
        decided.filter("kind = 1").select("h1", "h2", "doc", "body", "pos")
        .join(F.broadcast(edges), ["h1", "h2"])  # two a partition at most
        .filter(F.col("doc") != F.col("largest"))
    )
    dropped = decided.filter("kind = 0").select("doc", "body", "pos").unionByName(
        closed.select("doc", "body", "pos")
    )

    def pack(batch):
        out = {"doc": batch["doc"], "body": batch["body"], "n_dropped": [], "keep": []}
        for positions in batch["positions"]:
            bits = np.ones((max(positions) // 8 + 1) * 8, np.uint8)
            bits[positions] = 0
            out["n_dropped"].append(len(positions))
            out["keep"].append(zlib.compress(np.packbits(bits).tobytes()))
        return out

    per_doc = dropped.groupBy("doc", "body").agg(F.collect_set("pos").alias("positions"))
    return map_rows(per_doc, pack, "doc bigint, body bigint, n_dropped bigint, keep binary")


def kept_lines(text: str | None, keep: bytes | None) -> tuple[list[str], list[str]]:
    """All lines of a text, and those that its bitmap keeps."""
    lines = (text or "").split("\n")
    if keep is None:
        return lines, lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    gone = set(np.flatnonzero(bits == 0).tolist())
    return lines, [x for i, x in enumerate(lines) if i not in gone]


def with_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text, keep) for every row; ``keep`` is null where nothing goes."""
    return (
        _keyed(docs, id_col, text_col)
        .join(bitmaps.select("doc", "body", "keep"), ["doc", "body"], "left")
        .select("doc_id", "text", "keep")
    )


def digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row."""

    def run(batch):
        out = {"doc_id": batch["doc_id"], "n_lines": [], "n_dropped": [], "kept_sha256": []}
        for text, keep in zip(batch["text"], batch["keep"]):
            lines, kept = kept_lines(text, keep)
            out["n_lines"].append(len(lines))
            out["n_dropped"].append(len(lines) - len(kept))
            out["kept_sha256"].append(hashlib.sha256("\n".join(kept).encode()).hexdigest())
        return out

    schema = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string"
    return map_rows(with_bitmaps(docs, bitmaps), run, schema)


def cleaned(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with their kept lines as text, the other columns as they were.

    ``n_chars`` follows the text if there is such a column; a null text stays null.
    """
    columns = [c for c in docs.columns if c not in ("doc_id", "text")]
    base = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("_doc"),
        F.xxhash64("text").alias("_body"),
        "text",
        F.struct(*[F.col(f"`{c}`") for c in columns], F.lit(0).alias("_")).alias("_rest"),
    )
    joined = base.join(
        bitmaps.select(F.col("doc").alias("_doc"), F.col("body").alias("_body"), "keep"),
        ["_doc", "_body"],
        "left",
    ).select("doc_id", "text", "keep", "_rest")

    def run(batches):
        import pyarrow as pa

        slices = (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS))
        for b in slices:
            texts = [
                t if k is None or t is None else "\n".join(kept_lines(t, k)[1])
                for t, k in zip(b["text"].to_pylist(), b["keep"].to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(texts, pa.string()), b["_rest"]],
                names=["doc_id", "text", "_rest"],
            )

    schema = joined.select("doc_id", "text", "_rest").schema
    out = joined.mapInArrow(run, schema)
    length = {"n_chars": F.coalesce(F.length("text"), F.col("_rest.n_chars")).cast(
        docs.schema["n_chars"].dataType)} if "n_chars" in columns else {}
    return out.select(
        *[
            length[c].alias(c) if c in length
            else F.col(c) if c in ("doc_id", "text")
            else F.col(f"_rest.`{c}`").alias(c)
            for c in docs.columns
        ]
    )
