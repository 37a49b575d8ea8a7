"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its words, word pairs and character n-grams (all
hashed into one table); a softmax layer gives the class probabilities. Training is plain numpy
stochastic gradient descent on a bounded, documented sample of labelled documents; scoring covers
every row. The layer is linear, so the trained table folds into one number per bucket and class
before it is sent to the tasks (a fixed size, whatever the corpus).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import map_rows, pick, text_slices

MAX_TRAIN = 4000  # labelled documents that a model is fitted on
BITS, DIM = 16, 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_WORD = np.uint64(0xA0761D6478BD642F)
_PAIR = np.uint64(0xE7037ED1A0B428DB)
_POWERS = np.cumprod(np.full(64, _STEP, np.uint64))


def _buckets(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31)) ^ np.uint64(salt * 0x5851F42D4C957F2D % 2**64)) * _ODD
    return (h >> np.uint64(64 - BITS)).astype(np.uint16)


def _slice_features(text: str) -> list[np.ndarray]:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    if not n:
        return []
    space = (cp == 32) | ((cp >= 9) & (cp <= 13))
    mixed = np.where(space, np.uint64(7), (cp.astype(np.uint64) + np.uint64(11)) * _ODD)
    mixed ^= mixed >> np.uint64(29)
    before = np.concatenate(([0], np.cumsum(space)))
    out, h = [], mixed
    for size in (2, 3, 4):
        if n < size:
            break
        h = h[:-1] * _STEP + mixed[size - 1 :]
        inner = before[size - 1 : n] - before[1 : n - size + 2]  # white space strictly inside
        ends = space[: n - size + 1] & space[size - 1 :]
        out.append(_buckets(h[(inner == 0) & ~ends], size))
    word = ~space
    starts = np.flatnonzero(word & np.concatenate(([True], space[:-1])))
    if len(starts):
        ordinal = np.cumsum(word & np.concatenate(([True], space[:-1]))) - 1
        place = (np.arange(n) - starts[np.maximum(ordinal, 0)]) & 63
        terms = np.where(word, mixed * _POWERS[place], np.uint64(0))
        words = np.add.reduceat(terms, starts)
        out.append(_buckets(words * _WORD, 11))
        pairs = words[:-1] * _PAIR + words[1:]
        pairs[words[:-1] == words[1:]] = _PAIR  # any word twice in a row
        out.append(_buckets(pairs, 12))
    return out


def features(text: str | None) -> np.ndarray:
    """Bucket numbers of all features of a whole text, repeats included; empty for no text."""
    parts = [f for s in text_slices(text or "") for f in _slice_features(s)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint16)


@dataclass
class QualityModel:
    logits: np.ndarray  # one number per bucket: vector times (class 1 - class 0)
    bias: float

    def score(self, text: str | None) -> float:
        total, count = 0.0, 0
        for s in text_slices(text or ""):
            for f in _slice_features(s):
                total += float(self.logits[f].sum(dtype=np.float64))
                count += len(f)
        z = self.bias + (total / count if count else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))))


def fit(
    samples: list[tuple[np.ndarray, np.ndarray, int]],
    epochs: int = 12,
    rate: float = 0.8,
    seed: int = 7,
) -> QualityModel:
    """Gradient descent, one document a step. samples: (distinct buckets, counts, label).

    Without samples every score is 0.5; with one class only, scores lean to that class.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * max(1, len(samples)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            idx, counts, label = samples[i]
            share = (counts / max(1, counts.sum())).astype(np.float32)
            mean = share @ vectors[idx]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1.0
            lr = np.float32(rate * (1 - done / steps))
            back = weights @ p
            weights -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            # as usual for averaged vectors, each one gets the whole step of the mean
            vectors[idx] -= (lr * np.sqrt(share))[:, None] * back
            done += 1
    return QualityModel(
        (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0])
    )


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_train: int = MAX_TRAIN,
) -> QualityModel:
    """Fit on at most ``max_train`` labelled documents, taken in the order of a hash of the id.

    Null labels and null ids are left out; a repeated label counts as its smallest value.
    """
    chosen = (
        pick(labels, label_id=id_col, label=label_col)
        .filter("label_id is not null and label is not null")
        .groupBy("label_id")
        .agg(F.min("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(max_train)
    )
    pairs = pick(docs, id=id_col, text=text_col).join(
        F.broadcast(chosen), F.col("id") == F.col("label_id")  # max_train rows
    )

    def featurise(batch):
        out = {"id": batch["id"], "label": batch["label"], "buckets": [], "counts": []}
        for text in batch["text"]:
            idx, counts = np.unique(features(text), return_counts=True)
            out["buckets"].append(idx.tobytes())
            out["counts"].append(np.minimum(counts, 65535).astype(np.uint16).tobytes())
        return out

    schema = "id bigint, label int, buckets binary, counts binary"
    rows = map_rows(pairs.select("id", "label", "text"), featurise, schema).collect()
    rows.sort(key=lambda r: (r["id"], r["buckets"], r["label"]))
    return fit(
        [
            (
                np.frombuffer(r["buckets"], np.uint16).astype(np.int64),
                np.frombuffer(r["counts"], np.uint16).astype(np.float32),
                int(r["label"] > 0),
            )
            for r in rows
        ]
    )


def score(
    docs: DataFrame,
    model: QualityModel,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, score): probability of class 1 for every row; null and empty texts get the prior.

    Repeated rows and rows with a null id are scored like any other; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        return {"doc_id": batch["id"], "score": [sent.value.score(t) for t in batch["text"]]}

    return map_rows(pick(docs, id=id_col, text=text_col), run, "doc_id bigint, score double")
