"""Exact vector search and the deterministic hash embedding."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mixed_bytes
from ..settings import DEFAULTS
from .lexical import ranked

#: Query vectors that go to the tasks at a time, and that are scored at a time there.
BLOCK, STEP = 65_536, 512


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclid":
        return -np.sqrt(np.maximum(((q[:, None, :] - x[None, :, :]) ** 2).sum(-1), 0)) if len(q) * x.size < 1 << 24 else -np.stack([np.sqrt(((x - r) ** 2).sum(-1)) for r in q])
    dots = q @ x.T
    if metric == "dot":
        return dots
    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
    return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = DEFAULTS.top_k, metric: str = "cosine", key: str = "vec_id") -> DataFrame:
    """(query_id, key, score, rank): the k best of ``vectors`` (key, embedding) for each query.

    Queries go to the tasks as Arrow, ``BLOCK`` at a time; each task returns its k best for each
    query, and one window ranks what the tasks return. Scores have 6 decimals, ties go by the key.
    Rows whose embedding is null or holds a null are left out. Keys and ids are of any type.
    """
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    queries = queries.where(whole("embedding")).select("query_id", F.col("embedding").alias("q"))
    vectors = vectors.where(whole("embedding")).select(key, "embedding")
    blocks = max(1, -(-queries.count() // BLOCK))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, score double"
    out = vectors.sparkSession.createDataFrame([], schema)
    for block in range(blocks):
        table = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if not table.num_rows:
            continue
        ids = pa.concat_arrays(table.column("query_id").chunks)
        q = np.array(table.column("q").to_pylist(), np.float64)
        out = out.union(vectors.mapInArrow(_best(ids, q, k, metric, key), schema))
    return ranked(out, "score", k, key)


def _best(ids: pa.Array, q: np.ndarray, k: int, metric: str, key: str):
    def run(batches):
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            v = np.array(batch.column(key).to_pylist())
            if not len(v):
                continue
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
            by_key = np.argsort(np.argsort(v, kind="stable"), kind="stable")
            for first in range(0, len(q), STEP):
                s = np.round(_scores(x, q[first : first + STEP], metric), 6) + 0.0
                order = np.lexsort((np.broadcast_to(by_key, s.shape), -s))[:, :k]
                rows = np.repeat(np.arange(first, first + len(s)), order.shape[1])
                kept.append((rows, v[order.ravel()], np.take_along_axis(s, order, 1).ravel()))
            kept = [_first(kept, k)]
        if kept:
            r, v, s = kept[0]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), pa.array(v.tolist()), pa.array(s)], names=["query_id", key, "score"])

    return run


def _first(kept: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query among (query, key, score)."""
    r, v, s = (np.concatenate(x) for x in zip(*kept, strict=True))
    order = np.lexsort((v, -s, r))
    r, v, s = r[order], v[order], s[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], v[keep], s[keep]


def store_filter(filters: dict[str, object] | None) -> Column:
    """Conditions of a vector search: every key must match, a list by any of its values, by their text; None is no condition."""
    out = F.lit(True)
    for key, value in (filters or {}).items():
        if value is not None:
            wanted = [str(v) for v in value] if isinstance(value, list | tuple) else [str(value)]
            out = out & F.coalesce(F.col(key.removeprefix("metadata.")).cast("string").isin(wanted), F.lit(False))
    return out


def with_fallback(filtered: DataFrame, unfiltered: DataFrame, floor: float = DEFAULTS.min_vector_score) -> DataFrame:
    """Hits of a filtered search at or above the floor, with ``fallback_used``.

    A query that has none takes those of the search without the filter, at the floor as well.
    """
    good = filtered.where(F.col("score") >= floor).withColumn("fallback_used", F.lit(False))
    other = unfiltered.where(F.col("score") >= floor).withColumn("fallback_used", F.lit(True))
    return good.unionByName(other.join(good.select("query_id").distinct(), "query_id", "left_anti"))


def hash_vectors(texts: DataFrame, dim: int, key: str = "node_id") -> DataFrame:
    """(key, embedding): each token adds +1 or -1 to a bucket of its MD5; rows have length 1.

    A text without tokens, or whose signs cancel, has zeros.
    """

    def run(batches):
        known: dict[bytes, tuple[int, float]] = {}

        def place(token: bytes) -> tuple[int, float]:
            if token not in known:
                if len(known) > 100_000:
                    known.clear()
                digest = hashlib.md5(token).digest()
                known[token] = int.from_bytes(digest[:4], "big") % dim, 1.0 if digest[4] % 2 == 0 else -1.0
            return known[token]

        for whole in batches:
            for first in range(0, whole.num_rows, STEP):
                batch = whole.slice(first, STEP)
                n, lists = batch.num_rows, [mixed_bytes(t) for t in batch.column("text").to_pylist()]
                words = pa.array([w for found in lists for w in found], pa.binary()).dictionary_encode()
                places = [place(w) for w in words.dictionary.to_pylist()]
                at, sign = np.array([x for x, _ in places], np.int64), np.array([x for _, x in places])
                row = np.repeat(np.arange(n), [len(found) for found in lists])
                of = words.indices.to_numpy(zero_copy_only=False)
                v = np.bincount(row * dim + at[of], sign[of], n * dim).astype(np.float64).reshape(n, dim)  # of no tokens, integers
                norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
                v = np.divide(v, norm, out=v, where=norm > 0)
                offsets = pa.array(np.arange(0, (n + 1) * dim, dim), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], names=[key, "embedding"])

    kind = texts.schema[key].dataType.simpleString()
    lowered = F.lower(F.coalesce("text", F.lit(""))).alias("text")
    return texts.select(key, lowered).mapInArrow(run, f"{key} {kind}, embedding array<double>")


def merged(vectors: DataFrame, key: str = "node_id") -> DataFrame:
    """Weighted mean of the vectors (key, weight, embedding) of each key."""
    each = vectors.select(key, "weight", F.posexplode("embedding").alias("i", "v"))
    means = each.groupBy(key, "i").agg((F.sum(F.col("v").cast("double") * F.col("weight")) / F.sum("weight")).alias("v"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x.v).alias("embedding"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
