"""Quality classifier: naive Bayes support vectors.

Features are the byte n-grams (1 to 4) of the whole text and the n-grams (1 to 8) of its
word-repeat sequence (whether a word equals the one before it), as indicators, hashed to
``BUCKETS`` places. Each indicator is scaled by its class log-count ratio; on the scaled and
length-normalised rows a linear hinge-loss model is fitted by dual coordinate descent.
Margins of held-back folds fit the sigmoid that turns a margin into a score.

Learning uses a bounded sample of labelled rows (``SAMPLE_ROWS``, those of smallest key
hash); scoring covers every row and whole texts.

Defined results: null and empty texts have no n-grams and get the score of the bias alone.
Without labels of both classes every score is the share of label 1 (0.5 without labels).
A key with several labels counts by the highest, one with several texts by one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches

BUCKETS = 1 << 18
LONGEST_GRAM = 4
LONGEST_REPEAT = 8
SAMPLE_ROWS = 4000
BLOCK = 1 << 20


def grams(text: bytes, seen: np.ndarray) -> np.ndarray:
    """Sorted distinct n-gram places of a text; ``seen`` is a zeroed scratch array, left zeroed."""
    for lo in range(0, len(text), BLOCK):
        part = np.frombuffer(text[max(0, lo - LONGEST_GRAM + 1) : lo + BLOCK], dtype=np.uint8).astype(np.uint32)
        code = np.zeros(len(part) + 1, dtype=np.uint32)
        for n in range(1, min(LONGEST_GRAM, len(part)) + 1):
            code = (code[:-1] << np.uint32(8)) | part[n - 1 :]
            mixed = (code ^ np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(2654435761)
            seen[mixed >> np.uint32(14)] = True
    words = text.split()
    same = np.fromiter(map(eq, words, words[1:]), dtype=np.uint32, count=max(0, len(words) - 1))
    code = np.ones(len(same) + 1, dtype=np.uint32)
    for n in range(1, min(LONGEST_REPEAT, len(same)) + 1):
        code = (code[:-1] << np.uint32(1)) | same[n - 1 :]
        seen[((code ^ np.uint32(0x5BD1E995)) * np.uint32(2654435761)) >> np.uint32(14)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found.astype(np.int32)


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of the hinge-loss model, by dual coordinate descent."""
    w = np.zeros(BUCKETS + 1)
    alpha = np.zeros(len(y))
    rng = np.random.default_rng(seed)
    square = np.array([float(v @ v) for v in values]) + 1.0
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            ids, x = rows[i], values[i]
            slope = y[i] * (w[ids] @ x + w[-1]) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[ids] += step * y[i] * x
                w[-1] += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


@dataclass
class Model:
    weights: np.ndarray  # log-count ratio times weight, for each place
    squares: np.ndarray  # squared log-count ratios
    bias: float
    slope: float
    shift: float

    def margin(self, ids: np.ndarray) -> float:
        size = float(self.squares[ids].sum()) ** 0.5
        return (float(self.weights[ids].sum()) / size if size else 0.0) + self.bias

    def score(self, ids: np.ndarray) -> float:
        z = self.slope * self.margin(ids) + self.shift
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0


def _fit_margin(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> Model:
    p, q = np.full(BUCKETS, smooth), np.full(BUCKETS, smooth)
    for ids, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[ids] += 1
    seen = p + q > 2 * smooth + 1  # at least two rows hold it
    ratio = np.where(seen, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)
    values = []
    for ids in rows:
        v = ratio[ids]
        values.append(v / (np.sqrt(v @ v) or 1.0))
    n1 = max(1, int((y > 0).sum()))
    cost = np.where(y > 0, len(y) / (2 * n1), len(y) / (2 * max(1, len(y) - n1)))
    w = dual_descent(rows, values, y, cost)
    return Model((w[:-1] * ratio).astype(np.float32), (ratio**2).astype(np.float32), float(w[-1]), 1.0, 0.0)


def _sigmoid(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic fit on margins, with smoothed targets."""
    n1, n0 = int((y > 0).sum()), int((y <= 0).sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones_like(margins)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -60, 60)))
        g = x @ (p - target) + np.array([1e-3 * a, 0.0])
        h = (x * (p * (1 - p))) @ x.T + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, folds: int = 3) -> Model:
    y = np.where(labels > 0, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        share = float((y > 0).mean()) if len(y) else 0.5
        shift = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 0.0, shift)
    margins, used = np.zeros(len(y)), np.zeros(len(y), bool)
    for f in range(folds):
        out = np.arange(len(y)) % folds == f
        if abs(y[~out].sum()) == (~out).sum():
            continue
        part = _fit_margin([r for r, o in zip(rows, out, strict=True) if not o], y[~out])
        margins[out] = [part.margin(r) for r, o in zip(rows, out, strict=True) if o]
        used |= out
    model = _fit_margin(rows, y)
    if used.any():
        model.slope, model.shift = _sigmoid(margins[used], y[used])
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", learn_from: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from up to ``sample_rows`` labelled rows; ``learn_from`` (over the labels'
    columns) says which labels may be used."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known.filter(learn_from) if learn_from is not None else known
    known = known.groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    # Labels of absent documents don't use up the sample: keys meet before the choice.
    there = docs.select(F.col(key).alias("k")).distinct()
    in_small_batches(docs.sparkSession)
    chosen = known.join(there, "k", "left_semi").orderBy(F.xxhash64("k"), "k").limit(sample_rows)
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    # At most sample_rows keys: small enough to broadcast.
    one = texts.join(F.broadcast(chosen), "k").groupBy("k").agg(F.max("y").alias("y"), F.min_by("t", F.xxhash64("t")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, bool)
        for b in batches:
            ids = [grams(t.as_py().encode(), seen).tobytes() for t in b.column(2)]
            yield pa.record_batch([b.column(0).cast(pa.string()), b.column(1).cast(pa.float64()), pa.array(ids, pa.binary())], names=["k", "y", "ids"])

    got = sorted(one.mapInArrow(run, "k string, y double, ids binary").collect())
    return fit_rows([np.frombuffer(r[2], np.int32) for r in got], np.array([r[1] for r in got]))


def with_scores(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``score`` (replaced if there)."""
    in_small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: two arrays of BUCKETS
    rest = [c for c in docs.columns if c.lower() != score.lower()]
    slim = docs.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(rest)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, m = np.zeros(BUCKETS, bool), held.value
        for b in batches:
            got = pa.array([m.score(grams((t.as_py() or "").encode(), seen)) for t in b.column(0)], pa.float64())
            yield pa.record_batch([*b.columns[1:], got], names=[*b.schema.names[1:], "__score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:]), "__score double"])
    out = slim.mapInArrow(run, schema)
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(rest)], F.col("__score").alias(score))
