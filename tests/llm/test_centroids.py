"""Centroid clustering by a pivot table against brute force."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from sitelode.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, v string, cluster int, near string"


def rows_of(vectors):
    return [(i, v, "x", 1, "y") for i, v in vectors]


def brute(vectors, k, rounds, dims, seed=3):
    ok = lambda v: v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors if ok(v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    at = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                at[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *near(v)) for i, v in kept]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, j, d, sum(e for _, e, o in found if o == j), sum(e for _, e, _ in found), digest[j]) for i, d, j in found), key=repr)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("k,rounds,dims,sample", [(8, 10, 4, 50), (3, 1, 2, 1), (5, 4, 6, 0), (8, 0, 4, 2)])
def test_clusters(frame, values, k, rounds, dims, sample):
    rng = random.Random(k * 10 + rounds)
    spots = [[rng.uniform(-2, 2) for _ in range(dims)] for _ in range(4)]
    vectors = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(spots)]) for i in range(150)]
    vectors += [(i, spots[0]) for i in range(200, 260)]  # one vector many times: ties and equal starts
    vectors += [(7, vectors[7][1]), (7, spots[1]), (None, spots[2]), (None, spots[2]), (300, None), (301, []), (302, spots[0][:-1]), (303, spots[0] + [1.0]),
                (304, [None] + spots[0][1:]), (305, [float("nan")] + spots[0][1:]), (306, [float("-inf")] + spots[0][1:]), (307, [100000.0] * dims)]
    got = C.cluster_vectors(frame(SCHEMA, *rows_of(vectors)), k, rounds, dims=dims, sample=sample)
    assert values(got, *COLUMNS) == brute(vectors, k, rounds, dims)


def test_fewer_vectors_than_centroids(frame, values):
    vectors = [(1, [0.0, 1.0]), (2, [5.0, 1.0])]
    got = C.cluster_vectors(frame(SCHEMA, *rows_of(vectors)), 8, 10, dims=2)
    assert values(got, *COLUMNS) == brute(vectors, 8, 10, 2) and {r[2] for r in values(got, *COLUMNS)} == {0}


def test_nothing_kept(frame):
    empty = frame(SCHEMA, (1, None, "x", 1, "y"))
    assert C.cluster_vectors(empty, dims=2).isEmpty() and C.cluster_vectors(empty.limit(0), dims=2).isEmpty()


def test_out_of_range_is_an_error(frame):
    with pytest.raises(PySparkException, match="out of range: 9"):
        C.cluster_vectors(frame(SCHEMA, *rows_of([(9, [1e16, 0.0])])), dims=2)


def test_bounds_prune_and_stay_exact():
    rng = np.random.default_rng(4)
    spots = rng.integers(-4000, 4000, (8, 16))
    rows = spots[rng.integers(0, 8, 3000)] + rng.integers(-60, 60, (3000, 16))
    pivots = rows[:6]
    near = np.stack([C.whole_roots(C.squared(rows, p)) for p in pivots], 1)
    cluster, distance, exact = C.assign(rows, near, pivots, spots)
    every = np.stack([C.squared(rows, c) for c in spots], 1)
    assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert exact.mean() < 2.5


def test_whole_roots():
    around = np.array([r * r + d for r in (0, 1, 2, 3037000498, 94906267, 1 << 27) for d in (-1, 0, 1) if r * r + d >= 0], np.int64)
    roots = C.whole_roots(around)
    assert all(int(r) ** 2 <= int(x) < (int(r) + 1) ** 2 for r, x in zip(roots, around))
