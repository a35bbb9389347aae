"""Language identification by the nearest of several centroids of each language.

A text, lower-cased and with everything but letters as one space, becomes the TF-IDF vector of its
byte n-grams, hashed to a fixed number of places and of length one. The vectors of a language are
clustered by spherical k-means; a text gets the language of the centroid with the largest cosine.
Each centroid has a radius, within which all but a few of its training texts lie: a text beyond the
radius of its nearest centroid is rejected.

The fit uses at most about ``MAX_FIT`` distinct texts of each language, chosen by a hash of the text;
each language is clustered in a task of its own, which that bounds. Predictions read whole texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, pieces, released, text_of, texts_of, written
from .toxicity import held_out

#: Distinct texts of a language that the fit uses, about.
MAX_FIT = 1_500
#: More languages than this stop the run: the model has CENTROIDS * PLACES numbers for each.
MAX_LANGUAGES = 1_000
CENTROIDS, ROUNDS = 4, 6
PLACES = 4096
ORDERS = (1, 2, 3)
#: A radius holds this share of the centroid's training texts, and SLACK more.
WITHIN, SLACK = 0.995, 0.05
#: Bytes of a text worked on at a time.
SLICE = 1 << 20
PARTS = 32
UNKNOWN = "und"

LETTER = re.compile(r"[^\W\d_]")
OTHERS = re.compile(r"[\W\d_]+")


def letters_of(text: str) -> bytes:
    """The words of a text between single spaces; empty if it has no letter."""
    words = OTHERS.sub(" ", text.lower()).strip()
    return f" {words} ".encode() if words else b""


def n_grams(letters: bytes) -> np.ndarray:
    """Counts of the byte n-grams at their hashed places."""
    counts = np.zeros(PLACES, np.float32)
    reach = max(ORDERS) - 1
    for at in range(0, len(letters), SLICE):
        a = np.frombuffer(letters[at : at + SLICE + reach], np.uint8).astype(np.uint32)
        begins = min(SLICE, len(letters) - at)
        code = np.zeros(len(a), np.uint32)
        for n in range(1, reach + 2):
            if n > len(a):
                break
            code = code[: len(a) - n + 1] * np.uint32(257) + a[n - 1 :] + np.uint32(1)
            if n in ORDERS:
                place = (code[:begins] * np.uint32(2_654_435_761)) >> np.uint32(20)
                counts += np.bincount(place, minlength=PLACES).astype(np.float32)
    return counts


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one; rows without n-grams stay zero."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_means(x: np.ndarray, clusters: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(centroids of length one, radius of each as cosine distance) of rows of length one.

    The first centroid is the row nearest to the mean, each next one the row farthest from those before.
    """
    first = int(np.argmax(x @ x.mean(0)))
    chosen, best = [first], x @ x[first]
    while len(chosen) < min(clusters, len(x)):
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        at = np.argmax(x @ c.T, 1)
        sums = np.stack([x[at == k].sum(0) if (at == k).any() else c[k] for k in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    likeness = x @ c.T
    at = np.argmax(likeness, 1)
    radius = [np.quantile(1 - likeness[at == k, k], WITHIN) + SLACK if (at == k).any() else 0.0 for k in range(len(c))]
    return c.astype(np.float32), np.array(radius, np.float64)


class Model:
    """Centroids of all languages; without any, every text is unknown."""

    def __init__(self, idf: np.ndarray, fitted: list[tuple[str, np.ndarray, np.ndarray]]):
        fitted = sorted(fitted, key=lambda f: f[0])
        self.idf = idf
        self.languages = [name for name, c, _ in fitted for _ in c]
        self.centroids = np.concatenate([c for _, c, _ in fitted]) if fitted else np.zeros((0, PLACES), np.float32)
        self.radius = np.concatenate([r for *_, r in fitted]) if fitted else np.zeros(0)

    def nearest(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text; of equal cosines the first language by name."""
        letters = [letters_of(t) for t in texts]
        found: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        have = [i for i, t in enumerate(letters) if t]
        if have and self.languages:
            likeness = vectors(np.stack([n_grams(letters[i]) for i in have]), self.idf) @ self.centroids.T
            for i, row in zip(have, likeness, strict=True):
                k = int(np.argmax(row))
                found[i] = (self.languages[k], float(np.clip(row[k], 0, 1)), bool(1 - row[k] > self.radius[k]))
        return found


def _counted(batches):
    for batch in pieces(batches, 256):
        rows = [n_grams(letters_of(text_of(t))) for t in texts_of(batch)]
        places = [np.flatnonzero(r).astype(np.uint16) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(column_of(batch, "lang"), pa.string()),
                pa.array([p.tobytes() for p in places], pa.binary()),
                pa.array([r[p].tobytes() for r, p in zip(rows, places, strict=True)], pa.binary()),
            ],
            names=["lang", "places", "counts"],
        )


def _dense(places: list[bytes], counts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(places), PLACES), np.float32)
    for row, p, c in zip(out, places, counts, strict=True):
        row[np.frombuffer(p, np.uint16)] = np.frombuffer(c, np.float32)
    return out


def _occurring(batches):
    """The number of texts, then of those with each n-gram place."""
    total = np.zeros(1 + PLACES)
    for batch in batches:
        for p in column_of(batch, "places"):
            total[0] += 1
            total[1 + np.frombuffer(p, np.uint16)] += 1
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])


def train(docs: DataFrame, folds: int = 3, fold: int = 1) -> Model:
    """Fit on texts with letters and a language that are not held out; a null doc_id is not held out."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang is not null and text is not null").where(~held_out(F.col("doc_id"), folds, fold)).select("lang", "text")
    sizes = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    below = rows.sparkSession.createDataFrame([(r.lang, int(min(1.0, MAX_FIT / r["count"]) * 1e9)) for r in sizes], "lang string, below long")
    some = rows.join(F.broadcast(below), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1_000_000_000)) < F.col("below"))
    counted = written(some.select("lang", "text").distinct().mapInArrow(released(_counted), "lang string, places binary, counts binary").where("length(places) > 0"), "language")
    totals = [np.frombuffer(t, np.float64) for t in counted.coalesce(PARTS).mapInArrow(_occurring, "total binary").toArrow().column("total").to_pylist()]
    total = np.sum(totals, axis=0) if totals else np.zeros(1 + PLACES)
    idf = (np.log((1 + total[0]) / (1 + total[1:])) + 1).astype(np.float32)

    def fitted(table: pa.Table) -> pa.Table:
        # In an order that no shuffle changes.
        cells = sorted(zip(table.column("places").to_pylist(), table.column("counts").to_pylist(), strict=True))
        c, radius = spherical_means(vectors(_dense(*zip(*cells, strict=True)), idf))
        return pa.table({"lang": [table.column("lang")[0].as_py()], "centroids": [c.tobytes()], "radius": [radius.tobytes()]})

    found = counted.groupBy("lang").applyInArrow(fitted, "lang string, centroids binary, radius binary").collect()
    return Model(idf, [(r.lang, np.frombuffer(r.centroids, np.float32).reshape(-1, PLACES), np.frombuffer(r.radius, np.float64)) for r in found])


def _predicting(model: Model):
    def task(batches):
        for batch in pieces(batches, 128):
            found = model.nearest([text_of(t) for t in texts_of(batch)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(column_of(batch, "doc_id"), pa.int64()), pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return task


def identify_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for each row of ``docs`` (doc_id, text, lang).

    ``score`` is the cosine to the nearest centroid, ``rejected`` whether the text lies beyond its
    radius. A null text, or one without a letter, is ``und`` with a score of 0 and rejected; so is
    every text if nothing was learnt. Bytes that are not UTF-8 are no letters. Repeated rows each
    return a row; a row with a null doc_id is not held out. Other columns are not read.
    """
    model = train(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(released(_predicting(model)), "doc_id long, lang_pred string, score double, rejected boolean")
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "rejected")
