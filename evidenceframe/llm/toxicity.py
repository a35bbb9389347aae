"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; any other text is unlabelled and holds toxic text at
the class prior. A linear classifier over the presence of words and word beginnings is trained in
numpy on the risk ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``; where the corrected
negative part falls below zero, the step goes the other way, so that the model cannot fit the
unlabelled examples as negatives beyond what the prior allows.

The classifier is fitted on at most about ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` documents, chosen
by a hash of their ids; scores cover every row and whole texts. Tasks count features first, and only
those that mark positives come to the driver, so its memory does not follow the lengths of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_of, pieces, released, texts_of, written

MAX_POSITIVE = 4_000
MAX_UNLABELLED = 8_000
THRESHOLD = 0.3
#: The highest score where nothing could be learnt.
UNLEARNT = 0.2
BITS = 20
STEPS = 400
FDR = 0.02

#: ASCII other than letters, digits and apostrophes separates words here.
_BREAKS = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum() and c != 39), b" " * (128 - 63))


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text, modulo the folds."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def words_of(text: bytes | None) -> set[bytes]:
    return set(text.lower().translate(_BREAKS).split()) if text else set()


def features_of(word: bytes) -> tuple[int, ...]:
    """A word and its first four and five letters, hashed."""
    letters = word.decode(errors="replace")
    keys = {b"w" + word, b"4" + letters[:4].encode(), b"5" + letters[:5].encode()} if len(letters) > 3 else {b"w" + word}
    return tuple(xxhash.xxh3_64_intdigest(k) >> (64 - BITS) for k in keys)


class Features(dict):
    """Features of words, restricted to those that the model uses (all if None)."""

    def __init__(self, used: frozenset | None = None):
        super().__init__()
        self.used = used

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 60_000:
            self.clear()
        out = features_of(word)
        if self.used is not None:
            out = tuple(x for x in out if x in self.used)
        self[word] = out
        return out

    def present(self, text: bytes | None) -> set[int]:
        out: set[int] = set()
        for f in map(self.__getitem__, words_of(text)):
            if f:
                out.update(f)
        return out


def _counts(batches):
    """(feature, p, u): in how many positive and unlabelled examples of the task a feature is present."""
    known, sums = Features(), np.zeros((2, 1 << BITS), np.int64)
    for batch in pieces(batches, 1_024):
        kinds = zip(column_of(batch, "positive"), column_of(batch, "drawn"), strict=True)
        for text, both in zip(texts_of(batch), kinds, strict=True):
            present = np.fromiter(known.present(text), np.int64)
            for side, is_one in zip(sums, both, strict=True):
                if is_one:
                    side[present] += 1
    at = np.flatnonzero(sums.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["feature", "p", "u"])


def _examples(used: frozenset):
    def run(batches):
        known = Features(used)
        for batch in pieces(batches, 1_024):
            present = [np.sort(np.fromiter(known.present(t), np.uint32)).tobytes() for t in texts_of(batch)]
            names = ["positive", "drawn", "m0", "m1"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(present, pa.binary())], names=[*names, "features"])

    return run


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class PuModel:
    """Weights by feature and a bias; ``score`` is the estimated probability of being toxic."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, present: set[int]) -> float:
        x = self.bias + sum(self.weights[i] for i in sorted(present))
        return float(_sigmoid(np.array(x)))


def marking(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """Features that mark positives, from the number of positive and unlabelled examples that have each.

    They are more frequent there than chance allows (Chernoff bound of the Poisson tail), at a false
    discovery rate of FDR over all features that two positives have.
    """
    tested = np.flatnonzero(p >= 2)
    if not n_p or not n_u or not len(tested):
        return np.empty(0, np.int64)
    expected = n_p * (u[tested] + 0.5) / n_u
    k = p[tested].astype(float)
    tail = np.where(k > 3 * expected, k - expected - k * np.log(k / expected), 0.0)
    order = np.argsort(tail, kind="stable")
    passed = np.flatnonzero(tail[order] <= np.log(FDR * np.arange(1, len(order) + 1) / len(order)))
    return tested[order[: passed[-1] + 1]] if len(passed) else tested[:0]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, good: np.ndarray) -> PuModel:
    """Train on the features ``good`` of the examples.

    Without such features every score is the prior, but never one that would be predicted.
    """
    prior = min(max(prior, 1e-4), 0.5)
    base, size = float(np.log(prior / (1 - prior))), 1 << BITS
    if not positive or not unlabelled or not len(good):
        return PuModel({}, min(base, float(np.log(UNLEARNT / (1 - UNLEARNT)))))
    at = np.full(size, -1, np.int64)
    at[good] = np.arange(len(good))

    def rows(examples):
        cols = [at[e][at[e] >= 0] for e in examples]
        return np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate(cols) if cols else np.empty(0, np.int64), len(cols)

    rp, cp, n_p = rows(positive)
    ru, cu, n_u = rows(unlabelled)
    w, b = np.zeros(len(good)), base
    m, v = np.zeros(len(good) + 1), np.zeros(len(good) + 1)
    for step in range(1, STEPS + 1):
        gp = b + np.bincount(rp, w[cp], n_p)
        gu = b + np.bincount(ru, w[cu], n_u)
        sp, su = _sigmoid(gp), _sigmoid(gu)
        # Logistic loss: R_p(+) = mean log(1 + e^-g), R_.(-) = mean log(1 + e^g)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        up = -(1 - sp) * prior / n_p
        if negative >= 0:
            up = up - prior * sp / n_p
            un = su / n_u
        else:
            up = prior * sp / n_p  # the corrected risk is negative: undo the overfit
            un = -su / n_u
        grad = np.bincount(cp, up[rp], len(good)) + np.bincount(cu, un[ru], len(good)) + 1e-5 * w
        g = np.append(grad, up.sum() + un.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w = np.clip(w - move[:-1], 0.0, 12.0)
        b = float(b - move[-1])
    return PuModel({int(f): float(x) for f, x in zip(good, w, strict=True) if x > 1e-3}, b)


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2) -> PuModel:
    """Fit on the labels of rows outside the held-out fold; any other such text is unlabelled."""
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    labels = labels.where(~held_out(F.col("doc_id"), folds, fold)).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, positives = labels.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not positives:
        return PuModel({}, -6.0)
    share = min(1.0, MAX_POSITIVE / positives)
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    confirmed = labels.where("toxic = 1").where(bucket < int(share * 1_000_000)).select("doc_id", F.lit(True).alias("positive")).limit(2 * MAX_POSITIVE)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(~held_out(F.col("doc_id"), folds, fold))
    total = texts.where("doc_id is not null").count()
    some = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000_000)) < int(min(1.0, MAX_UNLABELLED / max(1, total)) * 1_000_000_000)
    taken = texts.where("doc_id is not null").join(F.broadcast(confirmed), "doc_id", "left").where(F.col("positive") | some)
    taken = taken.select(F.coalesce("positive", F.lit(False)).alias("positive"), some.alias("drawn"), "text")
    # copies count once
    marks = [F.xxhash64("text"), F.xxhash64("text", F.lit(1))]
    once = taken.groupBy(marks[0].alias("m0"), marks[1].alias("m1")).agg(F.max("positive").alias("positive"), F.max("drawn").alias("drawn"), F.first("text").alias("text"))
    once = written(once, "examples")
    n_p, n_u = once.agg(F.count_if("positive"), F.count_if("drawn")).first()
    sums = once.mapInArrow(released(_counts), "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toArrow()
    p, u = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    at = sums.column("feature").to_numpy().astype(np.int64)
    p[at], u[at] = sums.column("p").to_numpy(), sums.column("u").to_numpy()
    good = marking(p, u, n_p, n_u)
    rows = once.mapInArrow(released(_examples(frozenset(good.tolist()))), "positive boolean, drawn boolean, m0 long, m1 long, features binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["m0"], r["m1"]))  # so that reruns agree
    pos, unl = ([np.frombuffer(r["features"], np.uint32) for r in rows if r[kind]] for kind in ("positive", "drawn"))
    return fit(pos, unl, positives / n, good)


def _scores(model: PuModel):
    def run(batches):
        known = Features(frozenset(model.weights))
        for batch in batches:
            scores = [model.score(known.present(t)) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(column_of(batch, "doc_id"), pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    Null and empty texts score what a text without any known word scores. Repeated rows each
    return a row; a row with a null doc_id is not held out. Without labels nothing is predicted.
    """
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(released(_scores(model)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _kept(model: PuModel, threshold: float):
    def run(batches):
        known = Features(frozenset(model.weights))
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):  # few texts are Python objects at a time
                piece = batch.slice(at, 2_048)
                keep = [model.score(known.present(t)) < threshold for t in texts_of(piece)]
                yield piece.filter(pa.array(keep, pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; all columns stay."""
    return docs.mapInArrow(released(_kept(train(docs, labels), threshold)), docs.schema)
