"""Centroid clustering with a pivot table (LAESA).

Every vector's distances to a few fixed pivots are measured once and stored beside it. In each round the centroids' distances to the
same pivots are measured too; by the triangle inequality no distance between vector and centroid is less than the difference of their
distances to a pivot, so the largest such difference is a lower bound. A vector meets the centroid of its least bound first, and of the
others only those whose bound does not exceed the distance found: they survive and get exact distances, in whole numbers.

Bounds are tight where a pivot lies near a centroid, so the pivots are the starting centroids and those that a bounded draw of vectors ends
with. Which pivots there are changes the work, never the result.

Each task reads its share of the table and returns one sum for each centroid; the driver sees centroids only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import utf8_rows

DIMS, CENTROIDS, ROUNDS, SEED = 64, 8, 10, 3
# Vectors drawn to place pivots.
DRAWN = 2000
SCALE = 1024.0
# Largest component, scaled, whose squared distances over DIMS components stay whole 64-bit numbers.
LARGEST = 1 << 27

STORED = "vec_id long, v binary, near binary"
FOUND = "vec_id long, cluster int, distance long, exact int"


def kept_vectors(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """``vec_id, v`` of the vectors with exactly ``dims`` components, none null or non-finite; ``v`` has ``floor(1024 * x)`` of each.

    A kept component of 131,072 or more either way is an error: its squares would leave the range of whole numbers.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    sound = F.coalesce(F.size("embedding") == dims, F.lit(False)) & ~F.exists(
        "embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    limit = LARGEST / SCALE
    text = F.concat(F.lit("vector out of range: "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    scaled = F.transform("x", lambda e: F.when(F.abs(e) < limit, F.floor(e * SCALE)).otherwise(F.raise_error(text).cast("long")))
    return rows.select("vec_id", scaled.alias("v"))


def drawn(kept: DataFrame, n: int, salt: str) -> list[list[int]]:
    """The ``n`` vectors whose ``salt:vec_id`` have the smallest SHA-256, in that order; equal ids go by components, null ids come last."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [r["v"] for r in kept.orderBy(key.asc_nulls_last(), "v").limit(n).select("v").collect()]


def whole_roots(squares: np.ndarray) -> np.ndarray:
    """Square roots, rounded down exactly."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to one point."""
    apart = rows - point
    return np.einsum("ij,ij->i", apart, apart)


def _matrix(column, width: int) -> np.ndarray:
    raw, _ = utf8_rows(column)
    return np.frombuffer(raw.tobytes(), np.int32).reshape(-1, width).astype(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    narrow = np.ascontiguousarray(rows, np.int32)
    size = narrow.shape[1] * 4
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(narrow), [None, pa.py_buffer(narrow)]).cast(pa.binary())


def _measure(pivots: np.ndarray):
    """Adds the distances to the pivots, rounded down; below 2 ** 31, as components are below 2 ** 27."""
    def measure(batches):
        for batch in batches:
            v = batch.column(1)
            rows = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(v), -1)
            near = np.stack([whole_roots(squared(rows, p)) for p in pivots], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(rows), _binary(near)], ["vec_id", "v", "near"])
    return measure


def assign(rows: np.ndarray, near: np.ndarray, pivots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, ties to the smaller, its squared distance, and how many exact distances were made.

    ``near`` has the rows' distances to the pivots rounded down, so bounds give way by one.
    """
    n, at = len(rows), np.arange(len(rows))
    bound = np.zeros((n, len(centroids)), np.int64)
    for p, pivot in enumerate(pivots):
        np.maximum(bound, np.abs(near[:, p, None] - whole_roots(squared(centroids, pivot))[None, :]) - 1, out=bound)
    bound *= bound
    first = bound.argmin(1)
    cluster, distance, exact = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64)
    for c, centroid in enumerate(centroids):
        mine = at[first == c]
        cluster[mine], distance[mine] = c, squared(rows[mine], centroid)
    for c, centroid in enumerate(centroids):
        alive = at[(first != c) & (bound[:, c] <= distance)]
        if len(alive):
            d = squared(rows[alive], centroid)
            better = (d < distance[alive]) | ((d == distance[alive]) & (c < cluster[alive]))
            distance[alive[better]], cluster[alive[better]] = d[better], c
            exact[alive] += 1
    return cluster, distance, exact


def pivots_of(sample: np.ndarray, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Pivots: the starting centroids, and where they come to in the sample."""
    at, none = centroids.copy(), np.zeros((0, centroids.shape[1]), np.int64)
    for _ in range(rounds if len(sample) else 0):
        cluster, _, _ = assign(sample, np.zeros((len(sample), 0), np.int64), none, at)
        for c in np.unique(cluster):
            at[c] = sample[cluster == c].mean(0).astype(np.int64)
    return np.unique(np.concatenate((centroids, at)), axis=0)


def _sums(pivots: np.ndarray, centroids: np.ndarray):
    """One row for each centroid that has vectors in the task: their component sums and, last, their number."""
    dims = centroids.shape[1]

    def sums(batches):
        counts, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            rows = _matrix(batch.column(1), dims)
            cluster, _, _ = assign(rows, _matrix(batch.column(2), len(pivots)), pivots, centroids)
            counts += np.bincount(cluster, minlength=len(centroids))
            np.add.at(total, cluster, rows)
        some = np.nonzero(counts)[0]
        cells = np.concatenate((total, counts[:, None]), 1)[some].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(cells, pa.list_(pa.int64()))], ["cluster", "total"])
    return sums


def _assigned(pivots: np.ndarray, centroids: np.ndarray):
    def assigned(batches):
        for batch in batches:
            rows = _matrix(batch.column(1), centroids.shape[1])
            found = assign(rows, _matrix(batch.column(2), len(pivots)), pivots, centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[0].astype(np.int32)), pa.array(found[1]), pa.array(found[2].astype(np.int32))],
                                             ["vec_id", "cluster", "distance", "exact"])
    return assigned


def moved(stored: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: componentwise floor of the mean of their vectors; those without vectors stay."""
    sums = stored.mapInArrow(_sums(pivots, centroids), "cluster int, total array<long>")
    # At most one row for each centroid and component.
    found = sums.select("cluster", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    cells = {(r["cluster"], r["i"]): int(r["x"]) for r in found.collect()}
    dims, after = centroids.shape[1], centroids.copy()
    for c in {c for c, _ in cells}:
        after[c] = [cells[c, i] // cells[c, dims] for i in range(dims)]
    return after


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS,
                    sample: int = DRAWN) -> DataFrame:
    """``vec_id, cluster, distance, exact, cluster_inertia, inertia, centroid_sha256``, one row per kept vector of ``vectors``
    (``vec_id, embedding``; :func:`kept_vectors` says which are kept).

    Centroids 0, 1, ... start as the ``k`` kept vectors whose ``seed:vec_id`` have the smallest SHA-256, or as many as there are. Each round
    assigns every vector to the nearest centroid by squared Euclidean distance, ties to the smaller number, and
    replaces every centroid that has vectors by the floor of their mean. ``distance`` is the squared distance after the last round,
    ``exact`` the number of centroids that bounds left over, the inertias are sums of distances over the cluster and over all, the digest is
    that of the centroid's components joined by commas. Repeated rows and ids count each; vectors without an id take part but
    come last among the starts. No kept vectors give no rows. At most ``sample`` vectors, by a hash of their ids, are drawn to place pivots.
    """
    kept = kept_vectors(vectors, dims)
    spark, schema = kept.sparkSession, f"{FOUND}, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = np.array(drawn(kept, k, str(seed)), np.int64).reshape(-1, dims)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    fixed = pivots_of(np.array(drawn(kept, sample, f"pivot {seed}"), np.int64).reshape(-1, dims), centroids, rounds)
    stored = durable(kept.mapInArrow(_measure(fixed), STORED))
    for _ in range(rounds):
        before, centroids = centroids, moved(stored, fixed, centroids)
        if (before == centroids).all():
            break  # every further round would give the same
    found = durable(stored.mapInArrow(_assigned(fixed, centroids), FOUND))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    per = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    clusters = spark.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # At most k rows.
    return found.join(F.broadcast(clusters), "cluster").select(
        "vec_id", "cluster", "distance", "exact", "cluster_inertia", "inertia", "centroid_sha256")
