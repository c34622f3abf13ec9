"""Toxicity scores by FTRL-proximal logistic regression on hashed n-grams.

Features of a text (each counted once): words, word pairs, skip-grams over one
word, and word stems (the first 4, 5 and 6 letters), hashed to 2**20 places.
Training is sequential FTRL-proximal with per-coordinate learning rates and L1,
over a bounded, documented sample of labelled rows; L1 leaves a few thousand
weights, whose number is bounded by 2**20, so that the model is safe to ship to
every task.

Edge cases: null, empty and blank texts have no feature and score the bias.
Repeated rows score alike; a null ``doc_id`` counts as held out.  Labelled ids
that occur repeatedly use their largest label and their least text.  With no labelled row, or one
class only, every score is the share of the positive class (0.5 without rows).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, mix64, slices, span_hashes, training_fold, word_spans

BITS = 20
THRESHOLD = 0.5
SAMPLE_PER_CLASS = 2_500  # bound of the training sample: this many rows of either label
SAMPLE_CHARS = 12_000  # a labelled text longer than this is not used for training
_M = mix64(np.arange(201, 211, dtype=np.uint64)) | np.uint64(1)
_EDGE = np.frombuffer(b".,;:!?\"'()[]{}*#&$%|<>", np.uint8)


def features(text: str | None) -> np.ndarray:
    """The hashed features of a text, with repeats."""
    raw = text.encode("utf-8", "surrogatepass").lower() if text else b""
    starts, ends = word_spans(raw)
    if not len(starts):
        return np.empty(0, np.int64)
    # words lose punctuation at either end, up to three characters
    edge = np.zeros(256, bool)
    edge[_EDGE] = True
    buf = np.frombuffer(raw, np.uint8)
    for _ in range(3):
        starts = starts + (edge[buf[starts]] & (ends - starts > 1))
        ends = ends - (edge[buf[ends - 1]] & (ends - starts > 1))
    w = span_hashes(raw, starts, ends)
    with np.errstate(over="ignore"):
        parts = [w * _M[0], w[:-1] * _M[1] + w[1:] * _M[2], w[:-2] * _M[3] + w[2:] * _M[4]]
        for k, letters in enumerate((4, 5, 6)):
            long = ends - starts >= letters
            parts.append(span_hashes(raw, starts[long], starts[long] + letters) * _M[5 + k])
        return (mix64(np.concatenate(parts)) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Sparse weights: ascending feature ids, their weights, and the bias."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.ids] = self.weights
        return out


def ftrl(
    rows: list[np.ndarray], labels: np.ndarray, *, alpha: float = 0.1, beta: float = 1.0, l1: float = 2.0,
    l2: float = 1.0, epochs: int = 4, seed: int = 7,
) -> Model:
    """FTRL-proximal (McMahan et al. 2013) over rows of distinct feature ids."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bz = bn = 0.0
    order = np.random.default_rng(seed)

    def weight(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            ids = rows[r]
            zz, nn = z[ids], n[ids]
            w = weight(zz, nn)
            bw = -bz / ((beta + math.sqrt(bn)) / alpha)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()) + bw)))) - labels[r]
            z[ids] = zz + g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha * w
            n[ids] = nn + g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha * bw
            bn += g * g
    ids = np.flatnonzero(np.abs(z) > l1)
    return Model(ids, weight(z[ids], n[ids]).astype(np.float32), -bz / ((beta + math.sqrt(bn)) / alpha))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, per_class: int, chars: int
) -> tuple[DataFrame, float]:
    """A bounded sample ``(doc_id, text, y)`` of labelled rows outside the held-out
    fold, the rows of least hash in either class, and the share of positives among
    all of them.  At most ``2 * per_class`` rows of at most ``chars`` characters."""
    known = (
        labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
        .filter(training_fold(F.col("doc_id")) != 0)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col(target) > 0).cast("int")).alias("y"))
    )
    n, positive = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("y = 1").orderBy(*order).limit(per_class).union(
        known.filter("y = 0").orderBy(*order).limit(per_class)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.filter(F.coalesce(F.length("text"), F.lit(0)) <= chars).join(F.broadcast(picked), "doc_id")
    # of a repeated id's texts the least, so that reruns agree
    return sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")), (positive / n if n else 0.5)


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Features are made by the tasks; the driver gets the bounded sample's ids."""
    sample, share = labelled_sample(docs, labels, "toxic", per_class, SAMPLE_CHARS)

    def ids(batch: dict[str, list]) -> dict[str, object]:
        return {
            "doc_id": batch["doc_id"],
            "y": batch["y"],
            "f": [np.unique(features(t)).astype(np.int32).tobytes() for t in batch["text"]],
        }

    got = map_batches(sample.select("doc_id", "text", "y"), ids, "doc_id long, y int, f binary").toPandas()
    got = got.sort_values("doc_id")
    y = got["y"].to_numpy()
    if len(set(y)) < 2:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.empty(0, np.int64), np.empty(0, np.float32), math.log(p / (1 - p)))
    # the sample is balanced by class, so 0.5 weighs a missed toxic text like a lost clean one
    return ftrl([np.frombuffer(b, np.int32) for b in got["f"]], y)


def predictions(model: Model, texts: list[str | None], memo: dict[str, np.ndarray]) -> np.ndarray:
    """Scores of texts; ``memo`` keeps the dense weights between calls."""
    if not memo:
        memo["w"] = model.dense()
    w, out = memo["w"], []
    for t in texts:
        f = features(t)
        f = f[w[f] != 0]
        out.append(float(w[np.unique(f)].sum(dtype=np.float64)) + model.bias)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs(doc_id, text)``."""
    memo: dict[str, np.ndarray] = {}

    def run(batch: dict[str, list]) -> dict[str, object]:
        return {**{k: batch[k] for k in ("doc_id", "held")}, "score": predictions(model, batch["text"], memo)}

    held = (training_fold(F.col("doc_id")) == 0).alias("held")
    scored = map_batches(
        docs.select("doc_id", F.col("text").cast("string").alias("text"), held),
        run,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held boolean, score double",
    )
    return scored.select(
        "doc_id",
        F.col("held").alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def filter_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, in one pass without a join."""
    memo: dict[str, np.ndarray] = {}
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(predictions(model, part.column(at).to_pylist(), memo) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
