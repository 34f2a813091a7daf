"""The inverted multi-index against all pairs."""

import random

import numpy as np
import pytest

from surety.llm import embedding_dedup as m


def brute(rows, cosine=m.COSINE):
    def usable(v, label):
        return (v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v))
    n = len(rows)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    links = [0] * n
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if usable(a, la) and usable(b, lb) and la == lb and len(a) == len(b):
                x, y = np.array(a, np.float64), np.array(b, np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    out = [(r[0], links[i], low.get(find(i)), r[0] is not None and r[0] == low.get(find(i))) for i, r in enumerate(rows)]
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    return sorted((tuple(r) for r in m.near_duplicates(df).collect()), key=str)


def vectors(rng, n, size=16):
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            base = out[rng.randrange(len(out))]
            v = base + rng.choice((0.0, 0.02, 0.05)) * np.array([rng.gauss(0, 1) for _ in range(size)])
        else:
            v = np.array([rng.gauss(0, 1) for _ in range(size)])
        out.append(v)
    return [[float(np.float32(x)) for x in v] for v in out]


def test_chains_copies_and_labels(spark):
    rng = random.Random(1)
    rows = [(i, v, rng.choice((0, 0, 0, 1))) for i, v in enumerate(vectors(rng, 260))]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(30)]
    rows += [(1100 + i, [2 * x for x in rows[7][1]], rows[7][2]) for i in range(3)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_unusable_rows(spark):
    rng = random.Random(2)
    v = vectors(rng, 6, 8)
    rows = [(1, None, 0), (2, None, 0), (3, [0.0] * 8, 0), (4, [0.0] * 8, 0), (5, [], 0), (6, [1.0, None] + v[0][2:], 0),
            (7, [1.0, None] + v[0][2:], 0), (8, [float("nan")] + v[0][1:], 0), (9, [float("inf")] + v[0][1:], 0),
            (10, v[0], None), (11, v[0], None), (12, v[0], 0), (None, v[0], 0), (None, v[1], 0), (13, v[0][:4], 0), (14, v[0][:4], 0),
            (15, v[2], 1), (15, v[2], 1), (16, [-0.0, 1.0], 3), (17, [0.0, 1.0], 3), (18, [5.0], 4), (19, [3.0], 4), (20, [-3.0], 4),
            (21, [1.0, 2.0], 5), (22, [1.0, 2.0, None], 5), (23, [None, 1.0, 2.0], 5), (24, [1.0, 2.0, float("nan")], 5)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, [1.0, 2.0], 0)]])
def test_tiny_tables(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_hot_cells_are_split(spark):
    rng = random.Random(3)
    rows = [(i, v, 0) for i, v in enumerate(vectors(rng, 150, 6))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    distinct = m.distinct_vectors(df.selectExpr("*", "xxhash64(label, embedding) as node"))
    index = m.fit(distinct)
    whole = {r["node"]: r["s"] for r in m.link_counts(distinct, index).groupBy("node").agg({"links": "sum"}).withColumnRenamed("sum(links)", "s").collect()}
    parts = {r["node"]: r["s"] for r in m.link_counts(distinct, index, block=3, share=5).groupBy("node").agg({"links": "sum"}).withColumnRenamed("sum(links)", "s").collect()}
    assert whole == parts and whole


def test_visited_cells_hold_every_link():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 10))
    x[400:] = x[:400] + 0.06 * rng.normal(size=(400, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = m.MultiIndex(m.k_means(x[:, :5], 12), m.k_means(x[:, 5:], 12), 10)
    row, cell = index.visits(x)
    visited = set(zip(row.tolist(), cell.tolist()))
    own = index.cells(x)
    links = np.argwhere(x @ x.T >= m.COSINE)
    assert all((i, own[j]) in visited for i, j in links.tolist())
    assert len(visited) < 0.9 * 800 * 144


def test_traversal_takes_cells_by_their_bound():
    rng = np.random.default_rng(5)
    a, b = np.sort(rng.integers(0, 9, (50, 7)), 1) / 10, np.sort(rng.integers(0, 9, (50, 4)), 1) / 10
    row, i, j = m.multi_sequence(a, b, 0.6)
    total = a[:, :, None] + b[:, None, :]
    assert sorted(zip(row, i, j)) == list(zip(*np.nonzero(total <= 0.6)))
    for r in range(50):
        assert (np.diff(total[r][i[row == r], j[row == r]]) >= 0).all()
    assert [len(x) for x in m.multi_sequence(a, b, -1.0)] == [0, 0, 0]


def test_comparisons_and_recall_at_ten_thousand_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(100, 64))
    x = centres[rng.integers(0, 100, 10_000)] + 0.3 * rng.normal(size=(10_000, 64))
    x[8000:] = x[:2000] + 0.05 * rng.normal(size=(2000, 64))
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>, label int").repartition(8)
    index = m.fit(m.distinct_vectors(df.selectExpr("*", "xxhash64(label, embedding) as node")))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    _, cell = index.visits(unit)
    held = np.bincount(index.cells(unit), minlength=len(index.left) * len(index.right))
    assert held[cell].sum() < 0.15 * 10_000 ** 2
    got = {r["vec_id"]: r["n_links"] for r in m.near_duplicates(df).collect()}
    want = (unit @ unit.T >= m.COSINE).sum(1) - 1
    assert [got[i] for i in range(10_000)] == want.tolist() and want.sum() >= 4000
