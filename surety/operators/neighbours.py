"""Exact k-nearest-neighbour distance to a reference bank, with an index of balls.

Bank and queries of a group are cut into balls around pivots. From the centres and radii of two
balls follow the least and the largest similarity that any of their vectors can have. What the
balls with the largest "least" similarities hold ``k`` vectors of is a level that every query of a
ball reaches; bank balls that cannot come up to it are skipped, exactly.

Balls next to each other stand together on shelves of a bounded number of vector components, and a
shelf is one row of packed numbers. Pairs of shelves are skipped by the same bounds; each of the
others is a task group of its own, in which balls are paired. So what is shuffled follows the number
of shelves, not of balls, however small a ball is, and no pair of vectors is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.functions.columns import array_mean, let
from surety.plans.joins import bounded
from surety.plans.sketch import first_rows
from surety.session import materialise

#: Vectors of a ball, about.
BLOCK = 4096
#: Candidates for pivots of a group at most; balls of a larger group come in parts.
PIVOTS = 2048
#: Rows that look for their pivot together, at least.
CHUNK = 4 * BLOCK
#: Components of the vectors on a shelf of queries and on a shelf of the bank, about.
QUERY_SHELF, BANK_SHELF = 1 << 18, 1 << 20
#: A group that fills more shelves than this gets larger ones, up to so many times as large: each is sent to
#: every shelf it meets, so what is sent grows with the number of shelves.
QUERY_SHELVES, QUERY_GROWN, BANK_SHELVES, BANK_GROWN = 32, 8, 8, 2
#: Queries, and similarities, held at once.
STEP, SIMS = 512, 1 << 21
#: Bounds are widened by this share, far beyond what rounding can do.
SLACK = 1e-9


def _matrix(column: pd.Series | np.ndarray, unit: bool) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in column]) if isinstance(column, pd.Series) else column.astype(np.float64)
    if unit:
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)
    return m


def _usable(vector: Column) -> Column:
    """Vectors without a missing or non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False)) & (F.size(vector) > 0)


def _spread(candidates: np.ndarray) -> np.ndarray:
    """Half of the candidates, each the farthest from those taken before it, in the order of a walk to the nearest."""
    taken = [0]
    apart = np.linalg.norm(candidates - candidates[0], axis=1)
    while len(taken) < (len(candidates) + 1) // 2:
        taken.append(int(np.argmax(apart)))
        apart = np.minimum(apart, np.linalg.norm(candidates - candidates[taken[-1]], axis=1))
    left, walk = candidates[taken], [0]
    open_ = np.ones(len(left), bool)
    while len(walk) < len(left):
        open_[walk[-1]] = False
        walk.append(int(np.argmin(np.where(open_, np.linalg.norm(left - left[walk[-1]], axis=1), np.inf))))
    return left[walk]


def _pivots(candidates: DataFrame, keys: list[str], unit: bool) -> DataFrame:
    """``keys, _at, _p``: the pivots of every group, chosen once from its candidates ``_place, _v``."""
    schema = T.StructType([*[candidates.schema[c] for c in keys], *T._parse_datatype_string("_at bigint, _p array<double>").fields])

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        at = _spread(_matrix(frame.sort_values("_place")["_v"], unit))
        return frame[keys].iloc[np.zeros(len(at), int)].assign(_at=np.arange(len(at)), _p=list(at))

    return materialise(candidates.groupBy(*keys).applyInPandas(choose, schema))


def _in_balls(rows: DataFrame, keys: list[str], unit: bool, block: int) -> DataFrame:
    """Add ``_ball``: the nearest pivot of the group, and parts of about ``block`` vectors of it.

    ``rows`` has ``keys``, ``_rn`` and ``_v``. A group of at most ``block`` vectors is one ball. In
    larger ones the rows first by a hash of their number, four for each block, are candidates, and
    half of them, each the farthest from those before it, become pivots, so that clusters far apart
    do not share one. Pivots meet the rows of their group in chunks of at least ``CHUNK`` rows.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = bounded(sizes.where(F.col("_n") > block))
    if large.isEmpty():
        return rows.withColumn("_ball", F.lit(0).cast("bigint"))
    wanted = F.least(4 * F.ceil(F.col("_n") / block), F.lit(PIVOTS))
    chunks = F.ceil(F.col("_n") / max(4 * block, CHUNK)).cast("int")
    dealt = rows.join(large, keys)
    some = first_rows(dealt.withColumn("_hash", F.xxhash64("_rn")), keys, ["_hash", "_rn"], PIVOTS, "_place")
    pivots = _pivots(some.where(F.col("_place") <= wanted).select(*keys, "_place", "_v"), keys, unit)
    pivots = pivots.join(large, keys).select(
        *[F.col(c).alias(f"_of_{c}") for c in keys], "_p", "_at",
        F.explode(F.sequence(F.lit(0), chunks - 1)).alias("_of_chunk"))
    dealt = dealt.withColumn("_chunk", F.pmod(F.xxhash64("_rn"), chunks).cast("int"))
    schema = T.StructType([*rows.schema.fields, T.StructField("_ball", T.LongType())])
    names = rows.columns

    def place(part: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        out = part[names].assign(_ball=np.int64(0))
        if len(part) and len(at):
            at = _matrix(at.sort_values("_at")["_p"], False)
            ball = [np.argmin((at * at).sum(axis=1) - 2.0 * (_matrix(part["_v"].iloc[a:a + STEP], unit) @ at.T), axis=1)
                    for a in range(0, len(part), STEP)]
            out["_ball"] = np.concatenate(ball).astype(np.int64)
        return out

    placed = materialise(dealt.select(*names, "_chunk").groupBy(*keys, "_chunk").cogroup(
        pivots.groupBy(*[f"_of_{c}" for c in keys], "_of_chunk")).applyInPandas(place, schema))
    parts = bounded(placed.groupBy(*keys, "_ball").agg(F.ceil(F.count(F.lit(1)) / block).cast("bigint").alias("_parts")))
    part = F.pmod(F.xxhash64("_rn"), F.col("_parts"))
    placed = placed.join(parts, [*keys, "_ball"]).select(
        *[c for c in names], (F.col("_ball") * (1 << 32) + part).alias("_ball"))
    small = rows.join(large, keys, "left_anti").withColumn("_ball", F.lit(0).cast("bigint"))
    return placed.unionByName(small.select(*names, "_ball"))


def _shelves(rows: DataFrame, keys: list[str], unit: bool, components: int, many: int = 1 << 62, grown: int = 1) -> DataFrame:
    """One row per shelf: its vectors packed ball by ball, with size, centre, radius, shortest and longest vector.

    Balls of a group fill shelves of about ``components`` vector components in the order of their numbers.
    Where more than ``many`` shelves would be filled, they are up to ``grown`` times as large.
    """
    own = Window.partitionBy(*keys)
    balls = rows.groupBy(*keys, "_ball").agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("_v")).alias("_d"))
    before = F.sum("_n").over(own.orderBy("_ball")) - F.col("_n")
    width = F.max("_d").over(own)
    size = F.least(F.greatest(F.sum("_n").over(own) * width / many, F.lit(components)), F.lit(components * grown))
    balls = balls.select(*keys, "_ball", F.floor(before * width / size).cast("bigint").alias("_shelf"))
    placed = rows.join(bounded(balls), [*keys, "_ball"])
    outline = T._parse_datatype_string("n bigint, centre array<double>, radius double, least double, most double, _rns binary, _balls binary, _vs binary")
    schema = T.StructType([*[placed.schema[c] for c in [*keys, "_shelf"]], *outline.fields])
    kind = "<f4" if isinstance(rows.schema["_v"].dataType.elementType, T.FloatType) else "<f8"

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_ball", "_rn"])
        ball, v = frame["_ball"].to_numpy(), _matrix(frame["_v"], unit)
        centre, lengths = v.mean(axis=0), np.linalg.norm(v, axis=1)
        head = [frame[c].iloc[0] for c in [*keys, "_shelf"]]
        packed = [frame["_rn"].to_numpy("<i8"), np.flatnonzero(np.append(True, ball[1:] != ball[:-1])).astype("<i8"),
                  np.stack([np.asarray(x, dtype=kind) for x in frame["_v"]])]
        return pd.DataFrame([[*head, len(v), centre, np.linalg.norm(v - centre, axis=1).max(), lengths.min(), lengths.max(),
                              *[x.tobytes() for x in packed]]], columns=schema.names)

    return materialise(placed.groupBy(*keys, "_shelf").applyInPandas(pack, schema))


def _unpacked(shelf: pd.Series, kind: str, unit: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, vectors, and where balls begin and the last one ends."""
    rn = np.frombuffer(shelf["_rns"], "<i8")
    v = _matrix(np.frombuffer(shelf["_vs"], kind).reshape(len(rn), -1), unit)
    return rn, v, np.append(np.frombuffer(shelf["_balls"], "<i8"), len(rn))


def _outlines(v: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sizes, centres and radii of balls, and their shortest and longest vectors."""
    sizes, lengths = np.diff(starts), np.linalg.norm(v, axis=1)
    centres = np.add.reduceat(v, starts[:-1], axis=0) / sizes[:, None]
    radii = np.zeros(len(sizes))
    for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
        radii[i] = np.linalg.norm(v[a:b] - centres[i], axis=1).max()
    return sizes, centres, radii, np.minimum.reduceat(lengths, starts[:-1]), np.maximum.reduceat(lengths, starts[:-1])


def _meetings(queries: DataFrame, bank: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Pairs of shelves that must be compared: ``keys, _query, _bank``.

    With ``d`` between ``nearest`` and ``farthest``, a dot product is ``(|x|**2 + |y|**2 - d**2) / 2``.
    """
    def outlines(shelves: DataFrame, name: str) -> DataFrame:
        return shelves.select(*keys, F.struct("_shelf", "n", "centre", "radius", "least", "most").alias(name))

    both = outlines(queries, "q").join(outlines(bank, "b"), keys)
    q, b = F.col("q"), F.col("b")
    gap = F.sqrt(F.aggregate(F.zip_with(q["centre"], b["centre"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    slack = F.lit(SLACK) * (F.lit(1.0) + q["most"] * q["most"] + b["most"] * b["most"])
    met = both.select(*keys, q["_shelf"].alias("_query"), b["_shelf"].alias("_bank"), b["n"].alias("n"),
                      (gap + q["radius"] + b["radius"]).alias("farthest"),
                      F.greatest(gap - q["radius"] - b["radius"], F.lit(0.0)).alias("nearest"), slack.alias("slack"),
                      (q["least"] * q["least"] + b["least"] * b["least"]).alias("least"),
                      (q["most"] * q["most"] + b["most"] * b["most"]).alias("most"))
    met = met.withColumns({
        "low": (F.col("least") - F.col("farthest") * F.col("farthest")) / 2.0 - F.col("slack"),
        "high": (F.col("most") - F.col("nearest") * F.col("nearest")) / 2.0 + F.col("slack")})
    own = Window.partitionBy(*keys, "_query")
    so_far = F.sum("n").over(own.orderBy(F.col("low").desc(), "_bank"))
    reached = F.max(F.when(F.col("so_far") >= k, F.col("low"))).over(own)
    return (met.withColumn("so_far", so_far).withColumn("reached", reached)
            .where(F.col("reached").isNull() | (F.col("high") >= F.col("reached"))).select(*keys, "_query", "_bank"))


def _met_balls(queries: tuple[np.ndarray, ...], bank: tuple[np.ndarray, ...], k: int) -> Iterator[np.ndarray]:
    """For each ball of queries, which balls of the bank must be compared with it; bounds as for shelves."""
    sizes, centres, radii, least, most = bank
    for _, centre, radius, shortest, longest in zip(*queries):
        gap = np.linalg.norm(centres - centre, axis=1)
        slack = SLACK * (1.0 + longest * longest + most * most)
        low = (shortest * shortest + least * least - (gap + radius + radii) ** 2) / 2.0 - slack
        high = (longest * longest + most * most - np.maximum(gap - radius - radii, 0.0) ** 2) / 2.0 + slack
        order = np.argsort(-low, kind="stable")
        enough = np.searchsorted(np.cumsum(sizes[order]), k)
        yield high >= low[order[enough]] if enough < len(order) else np.ones(len(order), bool)


def _tops(v: np.ndarray, reference: np.ndarray, k: int) -> list[np.ndarray]:
    """The largest similarities of each query to the reference vectors."""
    out: list[np.ndarray] = []
    keep = min(k, len(reference))
    step = max(min(STEP, SIMS // len(reference)), 1)
    for a in range(0, len(v), step):
        some = v[a:a + step]
        top = np.argpartition(some @ reference.T, len(reference) - keep, axis=1)[:, len(reference) - keep:]
        # Products of blocks depend on the shape of the block in their last digit; these do not.
        out += list(np.einsum("id,ikd->ik", some, reference[top]))
    return out


def nearest_pairs(queries: DataFrame, bank: DataFrame, keys: Sequence[str], k: int, unit: bool = True,
                  block: int = BLOCK) -> DataFrame:
    """``(_rn, _top, _seen)``: a query's largest similarities on one bank shelf, and how many vectors it was compared with.

    Both sides have ``keys``, a row number ``_rn`` and a usable vector ``_v``.
    """
    keys = list(keys)
    left, right = (_shelves(_in_balls(rows, keys, unit, block), keys, unit, *shelf)
                   for rows, *shelf in ((queries, QUERY_SHELF, QUERY_SHELVES, QUERY_GROWN), (bank, BANK_SHELF, BANK_SHELVES, BANK_GROWN)))
    meetings = bounded(_meetings(left, right, keys, k))
    packed = ["_rns", "_balls", "_vs"]
    left = left.select(*keys, F.col("_shelf").alias("_query"), *packed).join(meetings, [*keys, "_query"])
    right = right.select(*keys, F.col("_shelf").alias("_bank"), *packed).join(meetings, [*keys, "_bank"])
    by = [*keys, "_query", "_bank"]
    right = right.withColumnsRenamed({c: f"_of_{c}" for c in by})
    schema = T.StructType([T.StructField("_rn", T.LongType()), T.StructField("_top", T.ArrayType(T.DoubleType())),
                           T.StructField("_seen", T.LongType())])
    kinds = ["<f4" if isinstance(rows.schema["_v"].dataType.elementType, T.FloatType) else "<f8" for rows in (queries, bank)]

    def compare(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rn, top, seen = np.zeros(0, np.int64), [], []
        if len(q) and len(b):
            rn, v, starts = _unpacked(q.iloc[0], kinds[0], unit)
            _, reference, bank_starts = _unpacked(b.iloc[0], kinds[1], unit)
            sizes = np.diff(bank_starts)
            for i, met in enumerate(_met_balls(_outlines(v, starts), _outlines(reference, bank_starts), k)):
                part = reference if met.all() else reference[np.repeat(met, sizes)]
                top += _tops(v[starts[i]:starts[i + 1]], part, k)
                seen += [len(part)] * int(starts[i + 1] - starts[i])
        return pd.DataFrame({"_rn": rn, "_top": top, "_seen": np.array(seen, np.int64)})

    return left.groupBy(*by).cogroup(right.groupBy(*[f"_of_{c}" for c in by])).applyInPandas(compare, schema)


def knn_distance(queries: DataFrame, bank: DataFrame, keys: Sequence[str], k: int,
                 row: Sequence[str], bank_row: str, vector: str = "embedding",
                 unit: bool = True, name: str = "distance",
                 block: int = BLOCK) -> DataFrame:
    """``1 - mean`` of the ``k`` largest cosine similarities to the bank of the same keys.

    One result per query row, with ``keys`` and ``row``: rows are told apart by a number, so
    repeated ids are rows of their own. With fewer than ``k`` bank vectors all of them count; a group
    without a bank gives NULL, and so does a vector that is NULL or empty or has a missing or
    non-finite component; such bank vectors take no part. Without ``unit`` vectors are taken as they
    are and similarities are dot products. ``bank_row`` is not needed any more and only kept for callers.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    keys, row = list(keys), list(row)
    numbered = materialise(queries.select(*dict.fromkeys([*keys, *row]), F.col(vector).alias("_v"))
                           .withColumn("_rn", F.monotonically_increasing_id()))
    held = materialise(bank.select(*keys, F.col(vector).alias("_v")).where(_usable(F.col("_v")))
                       .withColumn("_rn", F.monotonically_increasing_id()))
    pairs = nearest_pairs(numbered.where(_usable(F.col("_v"))).select(*keys, "_v", "_rn"), held, keys, k, unit, block)
    tops = pairs.groupBy("_rn").agg(F.flatten(F.collect_list("_top")).alias("_top"))
    best = F.slice(F.sort_array("_top", asc=False), 1, k)
    found = tops.select("_rn", (F.lit(1.0) - let(best, array_mean)).alias(name))
    return numbered.drop("_v").join(found, "_rn", "left").drop("_rn")
