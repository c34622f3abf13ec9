"""Document quality from a linear-chain conditional random field over lines.

Every line is a node with a good/bad label.  Its features describe the line and
both neighbouring lines; transition weights tie adjacent labels.  The marginal
probabilities of the forward-backward pass, weighted by line length in words, give
the share of good text of a document, which a one-dimensional logistic fit turns
into the score.

Labels exist for documents only, so training starts from the document's label on
each of its lines, then relabels the lines of bad documents by their own marginals
and fits again.  It uses a bounded sample: SAMPLE_PER_CLASS rows of either label,
texts of at most SAMPLE_CHARS characters and SAMPLE_LINES lines.  Scoring reads whole texts.

Chains run together only up to a bound on their padded length, so that a document of a
million lines runs alone and takes memory in proportion to its own text.

Edge cases: null, empty and blank texts are one empty line.  Repeated rows score
alike; a null ``doc_id`` counts as held out.  With no labelled row, or one class
only, every score is the share of label 1 (0.5 without rows).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, training_fold
from .toxicity import labelled_sample

SAMPLE_PER_CLASS = 1_200
SAMPLE_CHARS = 40_000
SAMPLE_LINES = 400
THRESHOLD = 0.3
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_SYMBOL = b"#*$%&|<>{}[]\\^~_=@+/"
_END = b"!?"
_POINT = b".,;:"
_HIGH = bytes(range(128, 256))
WIDTH = 16


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x WIDTH features, words per line)."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    out = np.zeros((len(lines), WIDTH), np.float32)
    sizes = np.zeros(len(lines))
    seen: set[bytes] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n, m = len(words), len(line)
        sizes[i] = n
        if not n:
            out[i, 0] = 1
            continue
        dense = m - line.count(b" ")
        per = 1.0 / max(1, dense)
        distinct = len(set(words))
        out[i] = (
            0,
            (m - len(line.translate(None, _UPPER))) * per,
            (m - len(line.translate(None, _LOWER))) * per,
            (m - len(line.translate(None, _DIGIT))) * per,
            min(1.0, 3 * (m - len(line.translate(None, _SYMBOL))) * per),
            min(1.0, 5 * (m - len(line.translate(None, _END))) * per),
            min(1.0, 5 * (m - len(line.translate(None, _POINT))) * per),
            (m - len(line.translate(None, _HIGH))) * per,
            distinct / n,
            math.log1p(n - distinct) / 5,
            sum(map(eq, words, words[1:])) / n,
            min(4.0, dense / n / 6),
            math.log1p(n) / 5,
            words[-1][-1:] in b".!?",
            line in seen,
            n < 4,
        )
        seen.add(line)
    return out, sizes


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features, and a constant."""
    zero = np.zeros((1, x.shape[1]), x.dtype)
    return np.hstack([x, np.vstack([zero, x[:-1]]), np.vstack([x[1:], zero]), np.ones((len(x), 1), x.dtype)])


def potentials(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``with_neighbours(x) @ weights`` without laying the neighbours side by side."""
    own, before, after = (x @ weights[i * x.shape[1] : (i + 1) * x.shape[1]] for i in range(3))
    own = own + weights[-1]
    own[1:] += before[:-1]
    own[:-1] += after[1:]
    return own


def _steps(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a padded (chains x longest) layout, and its mask."""
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = start[:, None] + np.arange(lengths.max())[None, :]
    mask = np.arange(lengths.max())[None, :] < lengths[:, None]
    return np.where(mask, at, 0), mask


def forward_backward(
    unary: np.ndarray, lengths: np.ndarray, trans: np.ndarray, with_pairs: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Marginals P(good) of each line and, on demand, the pairwise marginals summed over
    all neighbours (2 x 2), for chains laid end to end; ``unary`` is the good-label
    potential (bad has 0).  Chains run side by side, each in log space."""
    at, mask = _steps(lengths)
    n, longest = at.shape
    u = np.where(mask, unary[at], 0.0)
    fwd, bwd = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
    fwd[0, :, 1] = u[:, 0]
    for t in range(1, longest):
        step = np.logaddexp(fwd[t - 1, :, 0, None] + trans[0], fwd[t - 1, :, 1, None] + trans[1])
        step[:, 1] += u[:, t]
        fwd[t] = np.where(mask[:, t, None], step, fwd[t - 1])
    for t in range(longest - 2, -1, -1):
        ahead = bwd[t + 1].copy()
        ahead[:, 1] += u[:, t + 1]
        step = np.logaddexp(ahead[:, 0, None] + trans[:, 0], ahead[:, 1, None] + trans[:, 1])
        bwd[t] = np.where(mask[:, t + 1, None], step, 0.0)
    both = fwd + bwd
    p = 1 / (1 + np.exp(np.clip(both[:, :, 0] - both[:, :, 1], -50, 50)))
    pairs = np.zeros((2, 2))
    if longest > 1 and with_pairs:
        total = np.logaddexp(both[0, :, 0], both[0, :, 1])
        for a in (0, 1):
            for b in (0, 1):
                joint = fwd[:-1, :, a] + trans[a, b] + bwd[1:, :, b] + (u[:, 1:].T if b else 0.0) - total
                pairs[a, b] = np.exp(np.where(mask[:, 1:].T, joint, -np.inf)).sum()
    return p.T[mask], pairs


def side_by_side(lengths: np.ndarray, chains: int = 64, padded: int = 1 << 16) -> Iterator[np.ndarray]:
    """Numbers of the chains that run together: of like length, at most ``chains``, and at
    most ``padded`` lines once padded to the longest, unless a chain is longer alone."""
    some: list[int] = []
    for i in np.argsort(lengths, kind="stable").tolist():
        if some and (len(some) == chains or (len(some) + 1) * lengths[i] > padded):
            yield np.array(some)
            some = []
        some.append(i)
    if some:
        yield np.array(some)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    offset: float

    def marginals(self, xs: list[np.ndarray]) -> list[np.ndarray]:
        """P(good) for the lines of several documents."""
        out: list[np.ndarray] = [np.empty(0)] * len(xs)
        for some in side_by_side(np.array([len(x) for x in xs])):
            lengths = np.array([len(xs[i]) for i in some])
            u = np.concatenate([potentials((xs[i] - self.mean) / self.scale, self.weights) for i in some])
            p, _ = forward_backward(u, lengths, self.trans, with_pairs=False)
            for i, part in zip(some, np.split(p, np.cumsum(lengths)[:-1]), strict=True):
                out[i] = part
        return out

    def scores(self, xs: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        q = np.array([_share(p, s) for p, s in zip(self.marginals(xs), sizes, strict=True)])
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(q) + self.offset, -35, 35)))


def _share(p: np.ndarray, sizes: np.ndarray) -> float:
    """Length-weighted mean of the lines' marginals."""
    return float((p * sizes).sum() / sizes.sum()) if sizes.sum() else float(p.mean())


def _logit(q: np.ndarray) -> np.ndarray:
    return np.log((q + 1e-3) / (1 - q + 1e-3))


def _fit(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, weight: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by Adam on the conditional likelihood.  ``weight``
    holds one factor a chain, which balances the classes."""
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(trans)]
    v = [np.zeros_like(w), np.zeros_like(trans)]
    inner = np.ones(len(y), bool)
    inner[np.cumsum(lengths)[:-1]] = False  # rows that have a predecessor in their chain
    inner[0] = False
    seen = np.zeros((2, 2))
    prev = np.flatnonzero(inner)
    np.add.at(seen, (y[prev - 1], y[prev]), 1)
    per_row = np.repeat(weight, lengths)
    order = np.argsort(lengths, kind="stable")
    edges = np.concatenate([[0], np.cumsum(lengths)])
    blocks = [order[i : i + 100] for i in range(0, len(order), 100)]
    rows = [np.concatenate([np.arange(edges[i], edges[i + 1]) for i in b]) for b in blocks]
    n = len(y)
    for step in range(1, steps + 1):
        p, pairs, unary = np.empty(n), np.zeros((2, 2)), x @ w
        for b, r in zip(blocks, rows, strict=True):
            p[r], got = forward_backward(unary[r], lengths[b], trans)
            pairs += got
        grads = [x.T @ (per_row * (p - y)) / per_row.sum() + 1e-4 * w, (pairs - seen) / n + 1e-2 * trans]
        for k, (value, g) in enumerate(zip((w, trans), grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            value -= 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w, trans


def fit(xs: list[np.ndarray], sizes: list[np.ndarray], y: np.ndarray, share: float, steps: int = 60) -> Model:
    """Train on documents with labels ``y``; ``share`` is label 1's share of all labelled rows."""
    p = min(max(share, 1e-6), 1 - 1e-6)
    if len(set(y.tolist())) < 2:
        return Model(
            np.zeros(WIDTH), np.ones(WIDTH), np.zeros(3 * WIDTH + 1), np.zeros((2, 2)), 0.0, math.log(p / (1 - p))
        )
    flat = np.concatenate(xs)
    mean, scale = flat.mean(axis=0), flat.std(axis=0) + 1e-3
    lengths = np.array([len(x) for x in xs])
    full = np.concatenate([with_neighbours((x - mean) / scale) for x in xs]).astype(np.float64)
    weight = np.where(y > 0, p / y.mean(), (1 - p) / (1 - y.mean()))
    line_y = np.repeat(y, lengths)
    w, trans = _fit(full, line_y, lengths, weight, steps)
    model = Model(mean, scale, w, trans, 1.0, 0.0)
    # lines of bad documents that look good on their own are relabelled; each keeps its worst line
    for i, (q, at) in enumerate(zip(model.marginals(xs), np.cumsum(lengths) - lengths, strict=True)):
        if not y[i]:
            fixed = (q > 0.5).astype(int)
            fixed[int(np.argmin(q))] = 0
            line_y[at : at + lengths[i]] = fixed
    w, trans = _fit(full, line_y, lengths, weight, steps)
    model = Model(mean, scale, w, trans, 1.0, 0.0)
    z = _logit(np.array([_share(q, s) for q, s in zip(model.marginals(xs), sizes, strict=True)]))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a weighted, lightly penalised logistic fit
        f = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        h = weight * f * (1 - f) + 1e-9
        g = np.array([(weight * (f - y) * z).sum() + 0.1 * (a - 1), (weight * (f - y)).sum() + 0.1 * b])
        hess = np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return Model(mean, scale, w, trans, max(float(a), 1e-3), float(b))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Line features are made by the tasks; the driver gets those of the bounded sample."""
    sample, share = labelled_sample(docs, labels, "quality", per_class, SAMPLE_CHARS)

    def make(batch: dict[str, list]) -> dict[str, object]:
        rows = [i for i, t in enumerate(batch["text"]) if (t or "").count("\n") < SAMPLE_LINES]
        got = [line_features(batch["text"][i]) for i in rows]
        return {
            "doc_id": [batch["doc_id"][i] for i in rows],
            "y": [batch["y"][i] for i in rows],
            "x": [x.tobytes() for x, _ in got],
            "s": [s.tobytes() for _, s in got],
        }

    rows = map_batches(sample.select("doc_id", "text", "y"), make, "doc_id long, y int, x binary, s binary").toPandas()
    rows = rows.sort_values("doc_id")
    return fit(
        [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in rows["x"]],
        [np.frombuffer(b, np.float64) for b in rows["s"]],
        rows["y"].to_numpy(),
        share,
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs(doc_id, text)``."""

    def run(batch: dict[str, list]) -> dict[str, object]:
        got = [line_features(t) for t in batch["text"]]
        return {
            "doc_id": batch["doc_id"],
            "held": batch["held"],
            "score": model.scores([x for x, _ in got], [s for _, s in got]),
        }

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
