"""Centroid clustering of integer vectors: Lloyd's rounds, exact, with Shallot search.

Every vector carries its centroid, the centroid that was second nearest when it was last searched,
and two bounds: at most how far its own centroid is and at least how far all others are. After a
move of the centroids the bounds are widened by how far they went; a vector whose bounds (or half
the gap between its centroid and the next one) still tell the nearest is not looked at. For the
others the search starts from the closer of the two remembered centroids and walks along that
one's neighbours by distance. Only a centroid within the sum of the distances to the start and to
the second best so far can be among the best two, so the ball shrinks whenever a better one
is found, and the walk ends where it leaves the ball. Centroids inside are compared by integer
squared distances; ties go to the smaller number.

Bounds are doubles rounded outwards, so they never decide against the integers. Vectors and bounds
are written to the shared folder once a round and the table before is deleted; what
reaches the driver are sums per centroid and component, added up per slice of rows first. There
is no shuffle of vectors, so a centroid with a third of all vectors is no hot key.

Defined results: vectors that are NULL, of another length, or hold NULL or non-finite components
are left out; repeated ids and vectors are rows of their own; with fewer vectors than centroids
every vector is a start; rows without an id start only where no others are left; an empty table
gives no rows. A component of ``2**17`` or more in size raises an error, as squared distances would
no longer fit 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.llm.common import Scratch, arrow_map

CENTROIDS = 8
ROUNDS = 10
COMPONENTS = 64
SCALE = 1024
SALT = "3:"
#: Largest integer component; 64 squared differences of twice this fit 63 bits.
LARGEST = 1 << 27

STATE = "cluster int, second int, upper double, lower double"
RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def upwards(x: np.ndarray) -> np.ndarray:
    return x * (1 + 2.0 ** -50)


def downwards(x: np.ndarray) -> np.ndarray:
    return x * (1 - 2.0 ** -50)


def squared(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of int64."""
    apart = vectors - points
    return np.einsum("ij,ij->i", apart, apart)


class Centroids:
    """Centroids with what the search needs to know about them, and how far they moved."""

    def __init__(self, points: list[list[int]], before: Centroids | None = None) -> None:
        self.points = np.array(points, np.int64)
        k = len(self.points)
        gaps = np.sqrt(np.array([squared(self.points, p) for p in self.points], np.float64))
        #: Other centroids of each, nearest first, and at least how far they are.
        self.order = np.array([[j for j in np.argsort(row, kind="stable") if j != i] for i, row in enumerate(gaps)], np.int64).reshape(k, k - 1)
        self.gaps = downwards(np.take_along_axis(gaps, self.order, 1))
        self.half = self.gaps[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else upwards(np.sqrt(squared(self.points, before.points)))
        self.moved = moved
        #: For each centroid the largest move of another one.
        self.others = np.array([max((m for j, m in enumerate(moved) if j != i), default=0.0) for i in range(k)])

    def sha256(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in self.points.tolist()]


def search(vectors: np.ndarray, first: np.ndarray, second: np.ndarray, now: Centroids) -> tuple[np.ndarray, ...]:
    """Nearest and second nearest centroid of each vector with their squared distances, and how many distances were taken.

    ``first`` and ``second`` are two different guesses.
    """
    d1, d2 = squared(vectors, now.points[first]), squared(vectors, now.points[second])
    swap = (d2 < d1) | ((d2 == d1) & (second < first))
    start, other = np.where(swap, second, first), np.where(swap, first, second)
    d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
    best, next_best = start.copy(), other.copy()
    reach = upwards(np.sqrt(d1))
    taken = 2 * len(vectors)
    for c in np.unique(start).tolist():
        live = np.flatnonzero(start == c)
        for j, gap in zip(now.order[c].tolist(), now.gaps[c].tolist()):
            live = live[gap <= upwards(reach[live] + upwards(np.sqrt(d2[live])))]
            if not len(live):
                break
            test = live[other[live] != j]
            d = squared(vectors[test], now.points[j])
            taken += len(test)
            first_now = (d < d1[test]) | ((d == d1[test]) & (j < best[test]))
            win, lose = test[first_now], test[~first_now]
            d2[win], next_best[win], d1[win], best[win] = d1[win], best[win], d[first_now], j
            d = d[~first_now]
            second_now = (d < d2[lose]) | ((d == d2[lose]) & (j < next_best[lose]))
            d2[lose[second_now]], next_best[lose[second_now]] = d[second_now], j
    return best, next_best, d1, d2, taken


def assign(vectors: np.ndarray, state: tuple[np.ndarray, ...] | None, now: Centroids) -> tuple[np.ndarray, ...]:
    """``(cluster, second, upper, lower, distances taken)`` of each vector after the centroids moved.

    Without a state every vector is searched.
    """
    n, k = len(vectors), len(now.points)
    if k == 1:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, np.inf), 0
    taken = 0
    if state is None:
        cluster, second = np.zeros(n, np.int64), np.ones(n, np.int64)
        upper, lower = np.empty(n), np.empty(n)
        unsure = np.arange(n)
    else:
        cluster, second = (x.astype(np.int64) for x in state[:2])
        upper = upwards(state[2] + now.moved[cluster])
        lower = downwards(state[3] - now.others[cluster])
        surely = np.maximum(lower, now.half[cluster])
        unsure = np.flatnonzero(upper >= surely)
        upper[unsure] = upwards(np.sqrt(squared(vectors[unsure], now.points[cluster[unsure]])))
        taken += len(unsure)
        unsure = unsure[upper[unsure] >= surely[unsure]]
    best, next_best, d1, d2, looked = search(vectors[unsure], cluster[unsure], second[unsure], now)
    cluster[unsure], second[unsure] = best, next_best
    upper[unsure], lower[unsure] = upwards(np.sqrt(d1)), downwards(np.sqrt(d2))
    return cluster, second, upper, lower, taken + looked


def whole_vectors(df: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)``: usable vectors, each component ``floor(scale * x)``."""
    def whole(x: Column) -> Column:
        y = F.floor(F.lit(float(scale)) * x.cast("double"))
        return F.when(F.abs(y) <= LARGEST, y.cast("int")).otherwise(
            F.raise_error(F.lit(f"component too large for {scale} * x: squared distances would not fit 64 bits")).cast("int"))

    def usable(x: Column) -> Column:
        return F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))  # NaN is above infinity

    e = F.col("embedding")
    kept = df.where((F.size(e) == components) & F.forall(e, usable))
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(e, whole).alias("v"))


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)


def _assigned(table: DataFrame, now: Centroids) -> DataFrame:
    """Vectors with their state after ``now``; the first time they come without one."""
    known = "cluster" in table.columns
    schema = T.StructType([*table.select("vec_id", "v").schema.fields, *T._parse_datatype_string(STATE).fields])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        state = tuple(batch.column(c).to_numpy() for c in ("cluster", "second", "upper", "lower")) if known else None
        cluster, second, upper, lower, _ = assign(_vectors(batch), state, now)
        return pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower)],
            names=schema.names)

    return arrow_map(table, run, schema)


def _moved(table: DataFrame, now: Centroids) -> Centroids:
    """Centroids at the floor of the mean of their vectors; one without vectors stays."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cluster, vectors = batch.column("cluster").to_numpy(), _vectors(batch)
        found = np.unique(cluster)
        sums = [vectors[cluster == c].sum(axis=0).tolist() for c in found]
        return pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int32()), pa.array(np.bincount(cluster)[found], pa.int64()), pa.array(sums, pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"])

    parts = arrow_map(table.select("v", "cluster"), run, "cluster int, n bigint, sums array<bigint>")
    totals = (parts.select("cluster", "n", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place")
              .agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")))
    points = now.points.tolist()
    for cluster, place, n, total in totals.collect():  # as many rows as the centroids have components
        points[cluster][place] = int(total) // n
    return Centroids(points, now)


def cluster(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE,
            salt: str = SALT) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of all usable vectors.

    Starts are the ``k`` vectors with the smallest sha256 of ``salt`` and the id; equal ones are
    taken in the order of their components.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    table = scratch.keep(whole_vectors(df, components, scale))
    name = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    starts = table.orderBy(name.asc_nulls_last(), "v").select("v").limit(k).collect()
    if not starts:
        return spark.createDataFrame([], RESULT)
    now = Centroids([list(r["v"]) for r in starts])
    for _ in range(rounds):
        last, table = table, scratch.keep(_assigned(table, now))
        scratch.drop(last)
        now = _moved(table, now)
    final = now

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        state = tuple(batch.column(c).to_numpy() for c in ("cluster", "second", "upper", "lower")) if rounds else None
        vectors = _vectors(batch)
        found = assign(vectors, state, final)[0]
        return pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(found, pa.int32()), pa.array(squared(vectors, final.points[found]))], names=["vec_id", "cluster", "distance"])

    last, table = table, scratch.keep(arrow_map(table, run, "vec_id bigint, cluster int, distance bigint"))
    scratch.drop(last)
    sums = {c: int(s) for c, s in table.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    names = final.sha256()
    per_cluster = spark.createDataFrame([(c, s, names[c]) for c, s in sums.items()], "cluster int, cluster_inertia bigint, centroid_sha256 string")
    # One row per centroid.
    return table.join(F.broadcast(per_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("bigint").alias("inertia"), "centroid_sha256")
