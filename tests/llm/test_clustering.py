"""Shallot search against plain Lloyd rounds in Python integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from surety.llm import clustering

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows, k, rounds, components):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows
            if e is not None and len(e) == components and all(x is not None and math.isfinite(x) for x in e)]
    starts = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in starts]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), c in zip(kept, found) if c == j]
            if mine:
                centres[j] = [sum(column) // len(mine) for column in zip(*mine)]
    last = [nearest(v) for _, v in kept]
    per = {j: sum(d for d, c in last if c == j) for _, j in last}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, j, d, per[j], sum(per.values()), names[j]) for (i, _), (d, j) in zip(kept, last)], key=str)


def run(spark, rows, k=8, rounds=10, components=4):
    got = clustering.cluster(spark.createDataFrame(rows, SCHEMA), k, rounds, components)
    return sorted(map(tuple, got.collect()), key=str)


def points(n, components=4, seed=1, spread=0.2):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, components))
    return [(int(i), [float(x) for x in middles[rng.integers(6)] + rng.normal(scale=spread, size=components)]) for i in rng.permutation(n)]


@pytest.mark.parametrize("n, k, rounds", [(300, 8, 10), (200, 3, 4), (50, 1, 2), (5, 8, 2), (60, 8, 0)])
def test_against_plain_rounds(spark, n, k, rounds):
    rows = points(n)
    assert run(spark, rows, k, rounds) == plain(rows, k, rounds, 4)


def test_ties_and_repeated_rows(spark):
    # Whole numbers on a small grid: many vectors are as near to one centroid as to another.
    rng = np.random.default_rng(4)
    rows = [(int(i) % 90, [float(x) / 1024 for x in rng.integers(0, 3, 4)]) for i in range(200)]
    assert run(spark, rows, 8, 6) == plain(rows, 8, 6, 4)


def test_unusable_vectors(spark):
    rows = points(30) + [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0, 3.0]), (104, [1.0, float("nan"), 2.0, 3.0]),
                         (105, [1.0, float("inf"), 2.0, 3.0]), (None, [0.1, 0.2, 0.3, 0.4]), (106, [0.0] * 4)]
    got = run(spark, rows, 4, 3)
    assert got == plain(rows, 4, 3, 4) and len(got) == 32
    assert run(spark, [(1, None)]) == [] and run(spark, []) == []


def test_clashing_columns(spark):
    rows = points(40)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("cluster", "second", "upper", "lower", "v", "distance")})
    assert sorted(map(tuple, clustering.cluster(df, 4, 3, 4).collect()), key=str) == plain(rows, 4, 3, 4)


def test_too_large_components(spark):
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [2.0 ** 40] * 4)])


def test_fewer_distances_than_all(spark):
    """After the first round most vectors are not looked at, and a search looks at few centroids."""
    rng = np.random.default_rng(2)
    k, n = 40, 4000
    middles = rng.integers(-20_000, 20_000, (k, 16))
    vectors = middles[rng.integers(k, size=n)] + rng.integers(-800, 800, (n, 16))
    now = clustering.Centroids(vectors[:k].tolist())
    state, taken = None, []
    for _ in range(8):
        *state, looked = clustering.assign(vectors, state, now)
        whole = ((vectors[:, None] - now.points) ** 2).sum(axis=2)
        assert (state[0] == whole.argmin(axis=1)).all()
        taken.append(looked / (n * k))
        points = now.points.tolist()
        for c in range(k):
            if (state[0] == c).any():
                points[c] = (vectors[state[0] == c].sum(axis=0) // (state[0] == c).sum()).tolist()
        now = clustering.Centroids(points, now)
    assert taken[0] < 0.9 and max(taken[3:]) < 0.15
