"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic scores.

Statistics of a text (shares of characters, lengths, repetition) are standardised and mapped to
random Fourier features, which approximate a Gaussian kernel. Every partition sums its part of the
normal equations; the sums of at most ``PARTS`` partitions are added up and solved on the driver,
whose size is fixed by the number of features. Pool-adjacent-violators over a histogram of fitted
values turns ridge values into calibrated scores.

The fit uses at most about ``MAX_FIT`` labelled rows, chosen by a hash of their ids; scores cover
every row and whole texts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, texts_of, written
from .toxicity import held_out

MAX_FIT = 40_000
PARTS = 32
FEATURES = 256
RIDGE = 1e-3
BINS = 1_000

# Classes of ASCII characters, as what bytes.translate deletes.
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
STOPS = b".,;:'\"()-"
SYMBOLS = b"#$%&*@^~=_+<>/\\[]{}`"
SPACE = b"\t\n\x0b\x0c\r "
HIGH = bytes(range(128, 256))

N_STATS = 19


def statistics(text: bytes | None) -> list[float]:
    """Numbers that describe a text; zeros for an empty one."""
    words = text.split() if text else []
    if not words:
        return [0.0] * N_STATS
    n, k = len(text), len(words)
    share = lambda chars: (n - len(text.translate(None, chars))) / n
    letters = max(share(LETTERS), 1e-9)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    tails = sum(w[-1:] in b"#$%&*@!|^~=_+" for w in words)
    return [
        np.log1p(n), np.log1p(k), n / k / 10, share(UPPER) / letters, share(SYMBOLS), share(STOPS), share(b"!?"), share(DIGITS), share(b"|"),
        share(SPACE), share(HIGH), len(counts) / k, max(counts.values()) / k, len(counts) / np.sqrt(k) / 10, pairs / k, tails / k,
        np.log1p(k / len(lines)), len(set(lines)) / len(lines), sum(1 for c in counts.values() if c == 1) / k,
    ]


def _described(batches):
    for batch in batches:
        stats = [statistics(t) for t in texts_of(batch)]
        flat = np.array(stats, np.float64).reshape(-1, N_STATS)
        yield pa.RecordBatch.from_arrays([pa.array(column_of(batch, "y"), pa.float64()), pa.array([r.tobytes() for r in flat], pa.binary())], names=["y", "stats"])


def _matrix(batch) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(column_of(batch, "stats")), np.float64).reshape(-1, N_STATS)
    return x, np.array(column_of(batch, "y"), np.float64)


class Model:
    def __init__(self, mean, scale, features: int = FEATURES, gamma: float = 0.08, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(N_STATS, features)) * np.sqrt(2 * gamma)
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.beta = np.zeros(features + 1)
        self.knots, self.levels = np.array([0.0]), np.array([0.5])

    def mapped(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        f = np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)
        return np.hstack([f, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.mapped(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0)


def _summed(df: DataFrame, part, size: int) -> np.ndarray:
    """The sum over partitions of an array that ``part`` makes of each batch."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(*_matrix(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    rows = df.coalesce(PARTS).mapInArrow(run, "total binary").toArrow().column("total").to_pylist()
    return np.sum([np.frombuffer(r, np.float64) for r in rows], axis=0) if rows else np.zeros(size)


def isotonic(positive: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing rates closest to positive / count, by weight."""
    blocks: list[list[float]] = []
    for p, c in zip(positive, count, strict=True):
        blocks.append([p, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p2, c2, n2 = blocks.pop()
            blocks[-1][0] += p2
            blocks[-1][1] += c2
            blocks[-1][2] += n2
    return np.concatenate([np.full(int(n), p / c) for p, c, n in blocks]) if blocks else np.empty(0)


def fit(described: DataFrame) -> Model:
    """Fit on rows (y, stats). Three passes, each of which returns sums of a fixed size."""
    d = N_STATS
    sums = _summed(described, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * d)
    n = sums[0]
    if n == 0:
        return Model(np.zeros(d), np.ones(d))
    mean = sums[1 : 1 + d] / n
    scale = np.sqrt(np.maximum(sums[1 + d :] / n - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0))
    m = FEATURES + 1

    def normal(x, y):
        f = model.mapped(x)
        return np.concatenate([(f.T @ f).ravel(), f.T @ y])

    sums = _summed(described, normal, m * m + m)
    model.beta = np.linalg.solve(sums[: m * m].reshape(m, m) + RIDGE * max(n, 1) * np.eye(m) / 100, sums[m * m :])

    def histogram(x, y):
        at = np.clip(((model.raw(x) + 0.5) * BINS / 2).astype(np.int64), 0, BINS - 1)
        return np.concatenate([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])

    sums = _summed(described, histogram, 2 * BINS)
    positive, count = sums[:BINS], sums[BINS:]
    have = np.flatnonzero(count)
    model.knots = (have + 0.5) * 2 / BINS - 0.5
    model.levels = isotonic(positive[have], count[have])
    return model


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> Model:
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    labels = labels.where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, MAX_FIT / max(1, labels.count()))
    some = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000)) < int(share * 1_000_000_000)).limit(2 * MAX_FIT)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return fit(written(texts.join(F.broadcast(some), "doc_id").select("y", "text").mapInArrow(_described, "y double, stats binary"), "quality"))


def _scores(model: Model):
    def run(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in texts_of(batch)], np.float64).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([pa.array(column_of(batch, "doc_id"), pa.int64()), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    Null, empty and blank texts have zero statistics and are scored from those. Repeated rows each
    return a row; a row with a null doc_id is not held out. Without labels every score is 0.5.
    """
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_scores(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
