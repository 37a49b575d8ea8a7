"""Language identification by mixture inference.

Each language is a multinomial over hashed character n-grams, counted over all training rows. A
document is a mixture of languages: expectation-maximisation estimates the proportions, and the
language set is grown in order of proportion for as long as the log-likelihood gains more than a
penalty that grows with the logarithm of the evidence.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import SLICE_ROWS, map_rows, pick, stream_rows, text_slices

BITS = 15
NONE = "und"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LETTER = re.compile(r"[^\W\d_]")
_TABLE: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        _TABLE = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _TABLE


def ngram_counts(text: str) -> np.ndarray:
    """Counts per bucket of the 1- to 3-grams of letters, word ends included as one symbol."""
    total = np.zeros(1 << BITS, np.int64)
    for part in text_slices(text):
        cp = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[cp]
        cp = np.where(letter, cp, 0).astype(np.uint64)
        cp = np.concatenate(([0], cp, [0])).astype(np.uint64)
        cp = cp[np.concatenate(([True], (cp[1:] != 0) | (cp[:-1] != 0)))]
        mid = cp != 0
        one = cp[mid]
        two = (cp[:-1] << np.uint64(21)) | cp[1:]
        three = ((cp[:-2] << np.uint64(42)) | (cp[1:-1] << np.uint64(21)) | cp[2:])[mid[1:-1]]
        # the high bits tell the orders apart
        h = np.concatenate((one, two | np.uint64(1 << 62), three | np.uint64(1 << 63))) * _ODD
        h = (h ^ (h >> np.uint64(32))) * _ODD
        total += np.bincount((h >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    return total


@dataclass
class LanguageModel:
    languages: list[str]
    probs: np.ndarray  # language x bucket

    def mixture(self, text: str | None, penalty: float = 3.0) -> list[tuple[str, float, float]]:
        """(language, proportion, confidence), largest first; empty without letters or model."""
        if not text or not self.languages or not _LETTER.search(text):
            return []
        counts = ngram_counts(text)
        seen = np.flatnonzero(counts > 0)
        c = counts[seen].astype(np.float64)
        n = c.sum()
        if not n:  # numerals such as ½ pass as letters of the pattern
            return []
        p = self.probs[:, seen]
        p = p / p.max(axis=0)  # a factor per n-gram: proportions and gains stay as they are
        single = np.log(p) @ c / 3  # an n-gram order each: every letter is seen three times
        share = _em(p, c, np.full(len(p), 1 / len(p)), 12)
        order = np.argsort(-share, kind="stable")
        best = int(np.argmax(single))
        chosen, pi, likelihood = [best], np.ones(1), single[best]
        for k in (int(i) for i in order if i != best):
            if share[k] < 0.02:
                break
            trial = [*chosen, k]
            start = share[trial] + 1e-6
            mixed = _em(p[trial], c, start / start.sum(), 8)
            gained = float(np.log(np.maximum(mixed @ p[trial], 1e-300)) @ c) / 3
            if gained - likelihood <= penalty * np.log(n + 1):
                break
            chosen, pi, likelihood = trial, mixed, gained
        sure = 1 / np.exp(np.clip(single - single[best], -700, 0)).sum()
        found = sorted(zip(pi, chosen), key=lambda x: (-x[0], x[1]))
        return [(self.languages[k], float(w), float(sure * w)) for w, k in found]


def _em(p: np.ndarray, c: np.ndarray, pi: np.ndarray, rounds: int) -> np.ndarray:
    n = c.sum()
    for _ in range(rounds):
        pi = pi * (p @ (c / np.maximum(pi @ p, 1e-300))) / n
    return pi


def train(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.2
) -> LanguageModel:
    """Count n-grams over every row with a text and a language.

    Tasks add up their own rows first, so that a shuffle carries at most languages x buckets rows
    per task; the model that comes back has that size too, whatever the corpus.
    """

    def count(rows):
        sums: dict[str, np.ndarray] = {}

        def flush():
            for lang, counts in sums.items():
                for i in np.flatnonzero(counts):
                    yield lang, int(i), int(counts[i])
            sums.clear()

        for text, lang in rows:
            if lang not in sums:
                if len(sums) >= 64:
                    yield from flush()
                sums[lang] = np.zeros(1 << BITS, np.int64)
            sums[lang] += ngram_counts(text)
        yield from flush()

    rows = pick(docs, text=text_col, lang=lang_col).filter("text is not null and lang is not null")
    grams = stream_rows(rows, count, "lang string, bucket int, n bigint", batch_rows=65536)
    summed = grams.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = summed.groupBy("lang", F.floor(F.col("bucket") / 1024).alias("part")).agg(
        F.collect_list(F.struct("bucket", "n")).alias("cells")  # at most 1024
    )
    counts: dict[str, np.ndarray] = {}
    for row in packed.toLocalIterator():
        own = counts.setdefault(row["lang"], np.zeros(1 << BITS))
        for cell in row["cells"]:
            own[cell["bucket"]] = cell["n"]
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.empty((0, 1 << BITS)))
    raw = np.stack([counts[x] for x in languages]) + smoothing
    return LanguageModel(languages, raw / raw.sum(axis=1, keepdims=True))


def identify(
    docs: DataFrame,
    model: LanguageModel,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, lang_pred, score, languages) for every row.

    ``languages`` lists the chosen set with proportions, largest first. A null text, a text
    without a letter and an untrained model give ``und``, score 0 and an empty list; ties go to
    the language that sorts first. Rows with null ids or repeated ids are kept as they are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        found = [sent.value.mixture(t) for t in batch["text"]]
        return {
            "doc_id": batch["id"],
            "lang_pred": [x[0][0] if x else NONE for x in found],
            "score": [min(1.0, x[0][2]) if x else 0.0 for x in found],
            "languages": [[{"lang": a, "share": w} for a, w, _ in x] for x in found],
        }

    schema = (
        "doc_id bigint, lang_pred string, score double, "
        "languages array<struct<lang:string,share:double>>"
    )
    return map_rows(pick(docs, id=id_col, text=text_col), run, schema)


def with_language(rows: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of ``rows``, with ``lang_pred`` and ``score`` as in :func:`identify`."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    schema = StructType([*rows.schema.fields, *added])

    def run(batches):
        slices = (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS))
        for batch in slices:
            found = [sent.value.mixture(t) for t in batch[text_col].to_pylist()]
            columns = [
                *batch.columns,
                pa.array([x[0][0] if x else NONE for x in found], pa.string()),
                pa.array([min(1.0, x[0][2]) if x else 0.0 for x in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
