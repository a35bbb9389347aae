"""Centroid clustering of integer vectors by Lloyd rounds with Drake's adaptive bounds.

A vector keeps, from round to round, an upper bound of the distance to its centroid, a lower bound
for each of its next nearest centroids, and one remainder bound for all others. Centroids that moved
loosen the bounds by as much. A vector whose upper bound is below all lower ones stays where it is
without a distance computed; one whose upper bound is below the remainder looks only at the listed
centroids that may be nearer; any other is compared with all. The number of listed centroids shrinks
to what the last round needed. All decisions rest on exact integers: a bound decides only where it
holds by a margin above the rounding of doubles, and ties are always compared exactly.

State goes to the shared folder after each round; sums of a round are 64 columns for each cluster.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, discard, pieces, scratch, work_path

DIM, SCALE = 64, 64
CLUSTERS, ROUNDS = 16, 3
#: Listed centroids besides the nearest: at most, and at least.
LISTED, LEAST_LISTED = 4, 2
#: Components below this keep every squared distance within 64 bits.
LARGEST = 2**27
#: Relative and absolute margin, far above the rounding of a few sums of doubles.
MARGIN = 1e-9
#: Vectors worked on at a time.
STEP = 4096

STATE = "vec_id long, v array<int>, cluster int, looked int, used int, upper double, lower array<double>, listed array<int>, rest double"


def integer_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors of exactly 64 finite components, as integers floor(64 * x).

    An integer of 2**27 or more stops the run, as its squared distances need not fit in a long.
    """
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    kept = table.where((F.size("embedding") == DIM) & ~odd)
    large = F.exists(x, lambda e: F.abs(e * SCALE) >= LARGEST)
    whole = F.transform(x, lambda e: F.floor(e * SCALE).cast("int"))
    stop = F.raise_error(F.lit("a component is too large for squared distances in a long")).cast("array<int>")
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.when(large, stop).otherwise(whole).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors of the smallest sha256 of ``1:<vec_id>``, in that order; of equal ids the smallest vector first."""
    h = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(h.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r.v for r in rows], np.int64).reshape(-1, DIM)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c, pair by pair."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def to_all(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.stack([squared(x, c) for c in centroids], 1) if len(centroids) else np.empty((len(x), 0), np.int64)


class Assigned:
    """Clusters and bounds of a block of vectors."""

    def __init__(self, cluster, upper, lower, listed, rest):
        self.cluster, self.upper, self.lower, self.listed, self.rest = cluster, upper, lower, listed, rest
        self.looked = np.zeros(len(cluster), np.int32)
        self.used = np.zeros(len(cluster), np.int32)


def scanned(x: np.ndarray, centroids: np.ndarray, listed: int) -> Assigned:
    """All distances: nearest centroid, the next ones, and the one after as remainder."""
    d2 = to_all(x, centroids)
    listed = min(listed, len(centroids) - 1)
    order = np.argsort(d2, 1, kind="stable")
    d = np.sqrt(np.take_along_axis(d2, order, 1).astype(np.float64))
    rest = d[:, listed + 1] if len(centroids) > listed + 1 else np.full(len(x), np.inf)
    out = Assigned(order[:, 0].astype(np.int32), d[:, 0], d[:, 1 : listed + 1], order[:, 1 : listed + 1].astype(np.int32), rest)
    out.looked[:], out.used[:] = len(centroids), listed
    return out


def moved(x: np.ndarray, old: Assigned, centroids: np.ndarray, drift: np.ndarray, listed: int) -> Assigned:
    """The next round, after each centroid moved by ``drift``; at most ``listed`` centroids stay listed."""
    drift = drift * (1 + MARGIN)
    lower, ids, rest = old.lower - drift[old.listed], old.listed, old.rest - drift.max(initial=0.0)
    if listed < ids.shape[1]:
        rest = np.minimum(rest, lower[:, listed:].min(1))
        lower, ids = lower[:, :listed], ids[:, :listed]
    new = Assigned(old.cluster.copy(), old.upper + drift[old.cluster], lower.copy(), ids.copy(), rest.copy())
    above = lambda u: u * (1 + MARGIN) + MARGIN

    open_ = np.flatnonzero(above(new.upper) >= np.minimum(new.lower.min(1, initial=np.inf), new.rest))
    own = squared(x[open_], centroids[new.cluster[open_]])
    new.upper[open_], new.looked[open_] = np.sqrt(own.astype(np.float64)), 1
    far = above(new.upper[open_]) >= new.rest[open_]
    some, own = open_[~far], own[~far]
    if len(some) and new.lower.shape[1]:
        # Column 0 is the own centroid, the others the listed ones; a bound stands where none is computed.
        exact = np.full((len(some), 1 + new.lower.shape[1]), np.iinfo(np.int64).max)
        exact[:, 0] = own
        bound = np.concatenate([new.upper[some][:, None], new.lower[some]], 1)
        names = np.concatenate([new.cluster[some][:, None], new.listed[some]], 1)
        row, col = np.nonzero(above(new.upper[some])[:, None] >= new.lower[some])
        exact[row, col + 1] = squared(x[some[row]], centroids[names[row, col + 1]])
        bound[row, col + 1] = np.sqrt(exact[row, col + 1].astype(np.float64))
        np.add.at(new.looked, some[row], 1)
        np.maximum.at(new.used, some[row], (col + 1).astype(np.int32))
        # Nearest by exact distance, of equals the smaller number.
        best = np.lexsort((names, exact), axis=1)[:, 0]
        at = np.arange(len(some))
        for a in (bound, names):
            a[at, best], a[at, 0] = a[at, 0].copy(), a[at, best].copy()
        new.upper[some], new.cluster[some] = bound[:, 0], names[:, 0]
        new.lower[some], new.listed[some] = bound[:, 1:], names[:, 1:]
    again = open_[far]
    if len(again):
        whole = scanned(x[again], centroids, new.lower.shape[1])
        for name in ("cluster", "upper", "lower", "listed", "rest", "used"):
            getattr(new, name)[again] = getattr(whole, name)
        new.looked[again] = len(centroids)
    return new


def _matrix(batch, column: str, kind) -> np.ndarray:
    cells = batch.column(batch.schema.get_field_index(column))
    return np.asarray(cells.flatten(), kind).reshape(batch.num_rows, -1 if len(cells.flatten()) else 0)


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), kind))


def _assigning(centroids: np.ndarray, drift: np.ndarray | None, listed: int):
    def task(batches):
        for batch in pieces(batches, STEP):
            x = _matrix(batch, "v", np.int64)
            if drift is None:
                new = scanned(x, centroids, listed)
            else:
                plain = lambda c: np.asarray(batch.column(batch.schema.get_field_index(c)))  # noqa: B023, E731
                old = Assigned(plain("cluster"), plain("upper"), _matrix(batch, "lower", np.float64), _matrix(batch, "listed", np.int32), plain("rest"))
                new = moved(x, old, centroids, drift, listed)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(column_of(batch, "vec_id"), pa.int64()), _lists(x.astype(np.int32), pa.int32()), pa.array(new.cluster, pa.int32()), pa.array(new.looked, pa.int32()),
                    pa.array(new.used, pa.int32()), pa.array(new.upper), _lists(new.lower, pa.float64()), _lists(new.listed, pa.int32()), pa.array(new.rest),
                ],
                names=["vec_id", "v", "cluster", "looked", "used", "upper", "lower", "listed", "rest"],
            )

    return task


def averaged(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """Componentwise floor of the means of the clusters, empty ones unchanged; and the list places used."""
    sums = [F.sum(F.col("v")[i].cast("bigint")).alias(f"s{i}") for i in range(DIM)]
    out, used = centroids.copy(), 0
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("used").alias("used"), *sums).collect():
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(DIM)]
        used = max(used, r.used)
    return out, used


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, listed: int = LISTED) -> tuple[DataFrame, np.ndarray]:
    """State of the last assignment and the final centroids of (vec_id, v).

    ``looked`` is the number of distances computed for a vector in that assignment.
    """
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, clusters)
    if not len(centroids):
        return spark.createDataFrame([], STATE), centroids

    def assigned(rows, drift):
        path = work_path(spark, "assigned")
        rows.mapInArrow(_assigning(centroids, drift, listed), STATE).write.parquet(path)
        return spark.read.schema(STATE).parquet(path), path

    state, path = assigned(vectors, None)
    for _ in range(rounds):
        now, used = averaged(state, centroids)
        drift = np.sqrt(squared(now, centroids).astype(np.float64))
        centroids, listed, before = now, max(min(listed, used), min(LEAST_LISTED, listed)), path
        state, path = assigned(state, drift)
        discard(spark, before)
    return state, centroids


def cluster_vectors(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of ``table`` (vec_id, embedding).

    Vectors that are null, of another length or with a null or non-finite component are left out. A null
    vec_id counts as the empty text where its hash is taken; repeated rows each return a row. With
    fewer vectors than clusters there are as many clusters as vectors. Other columns are not read.
    An empty table gives no rows.
    """
    spark = table.sparkSession
    path = work_path(spark, "clusters")
    with scratch(spark):
        state, centroids = clustered(integer_vectors(table), clusters, rounds)

        def measured(batches):
            for batch in pieces(batches, STEP):
                x, cluster = _matrix(batch, "v", np.int64), np.asarray(batch.column(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(squared(x, centroids[cluster]))], names=["vec_id", "cluster", "distance"])

        state.select("vec_id", "v", "cluster").mapInArrow(measured, "vec_id long, cluster int, distance long").write.parquet(path)
    found = spark.read.schema("vec_id long, cluster int, distance long").parquet(path)
    inertia = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    rows = [(c, s, sum(inertia.values()), digest(c)) for c, s in inertia.items()]
    totals = F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # a row a cluster
    return found.join(totals, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_ROUND = """
    d{r} AS (SELECT vec_id, kept.v, c.k, list_sum(list_transform(kept.v, lambda x, i: (x - c.v[i]) * (x - c.v[i]))) AS d FROM kept, c{r} c),
    a{r} AS (SELECT vec_id, v, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{r} GROUP BY vec_id, v),
    s{r} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY k, i),
    m{r} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY k),
    c{t} AS (SELECT c.k, CAST(coalesce(m.v, c.v) AS BIGINT[]) AS v FROM c{r} c LEFT JOIN m{r} m USING (k)),"""

ORACLE_SQL = f"""
WITH kept AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (
    SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {CLUSTERS})
),{"".join(_ROUND.format(r=r, t=r + 1) for r in range(ROUNDS))}
    dl AS (SELECT vec_id, kept.v, c.k, list_sum(list_transform(kept.v, lambda x, i: (x - c.v[i]) * (x - c.v[i]))) AS d FROM kept, c{ROUNDS} c),
    al AS (SELECT vec_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM dl GROUP BY vec_id, v)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM al JOIN c{ROUNDS} c USING (k)
"""
