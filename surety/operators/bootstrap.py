"""Percentile intervals of any metric from replicate weights.

A metric is what it does with weighted rows. :class:`Sums` covers metrics that are made of sums
over rows, possibly over cells such as the bins of a calibration error; :class:`Ordered` covers those
that walk down an order, such as the area under a risk-coverage curve. Every replicate is one
weight per row, so the metric is computed for all replicates in the same passes, and for
the rows as they are (all weights 1) along with them. Metrics of one call share their replicates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.functions.columns import finite
from surety.plans.ranking import PID, group_starts, ranged, spread
from surety.plans.replicates import weights_of, with_weights
from surety.plans.resample import percentile_interval
from surety.session import materialise

#: Replicate number of the rows as they are.
POINT = -1


@dataclass(frozen=True)
class Sums:
    """``value`` of the weighted sums of ``sums``, taken per cell where there are cells.

    ``value`` aggregates over the cells of a replicate; ``n`` is always among the sums.
    """

    sums: Mapping[str, Column]
    value: Column
    cell: Column | None = None
    where: Column | None = None


@dataclass(frozen=True)
class Ordered:
    """A walk over rows in ascending ``order`` that sees how much weight came before.

    ``step(weights, x, n_before, x_before)`` gives what each replicate gains on a block of rows;
    weights and what came before are rows by replicates, ``x`` is the column ``x`` of the rows. The
    metric is the sum of the gains divided by the weight of the group.
    """

    order: Column
    x: Column
    step: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray] = field(repr=False)
    where: Column | None = None


def mean_of(value: Column) -> Sums:
    """Weighted mean of the rows where ``value`` is known."""
    return Sums({"s": value.cast("double")}, F.try_divide(F.sum("s"), F.sum("n")), where=value.isNotNull())


def brier(score: str = "anomaly_score", label: str = "label") -> Sums:
    miss = F.col(score) - F.col(label)
    return Sums({"s": miss * miss}, F.try_divide(F.sum("s"), F.sum("n")), where=finite(F.col(score)))


def coverage(correct: str = "covered") -> Sums:
    """Share of rows for which ``correct`` holds."""
    return mean_of(F.col(correct).cast("int"))


def ece(n_bins: int = 15, score: str = "anomaly_score", label: str = "label") -> Sums:
    """Expected calibration error over ``n_bins`` bins of equal width on [0, 1]."""
    s = F.col(score)
    cell = F.least(F.floor(F.greatest(F.least(s, F.lit(1.0)), F.lit(0.0)) * n_bins), F.lit(n_bins - 1)).cast("int")
    gap = F.abs(F.col("y") - F.col("s"))
    return Sums({"s": s.cast("double"), "y": F.col(label).cast("double")}, F.try_divide(F.sum(gap), F.sum("n")), cell, finite(s))


def _risk_gains(weights: np.ndarray, wrong: np.ndarray, n_before: np.ndarray, wrong_before: np.ndarray) -> np.ndarray:
    """Risks of the prefixes that end on each copy of each row."""
    gains = np.zeros(weights.shape[1])
    wrong = wrong[:, None]
    for copy in range(1, int(weights.max(initial=0)) + 1):
        drawn = weights >= copy
        gains += np.where(drawn, (wrong_before + copy * wrong) / np.maximum(n_before + copy, 1), 0.0).sum(axis=0)
    return gains


def aurc(uncertainty: str, correct: str = "correct") -> Ordered:
    """Area under the risk-coverage curve; missing uncertainty goes last."""
    u = F.col(uncertainty).cast("double")
    return Ordered(F.when(finite(u), u).otherwise(F.lit(float("inf"))), 1.0 - F.col(correct).cast("int"), _risk_gains)


def _with_ones(column: pa.Array, n_boot: int) -> np.ndarray:
    w = weights_of(column.to_pylist(), n_boot)
    return np.hstack([np.ones((len(w), 1), np.uint8), w])


def _sums(rows: DataFrame, group: list[str], metric: Sums, n_boot: int) -> DataFrame:
    """``group, rep, value`` of a metric made of sums."""
    names = ["n", *metric.sums]
    wanted = rows if metric.where is None else rows.where(metric.where)
    cell = F.lit(0) if metric.cell is None else metric.cell
    wanted = wanted.select(*group, cell.cast("int").alias("_cell"), F.lit(1.0).alias("n"), *[c.alias(s) for s, c in metric.sums.items()], "_w")
    keys = [*group, "_cell"]
    schema = T.StructType([*[wanted.schema[c] for c in keys], T.StructField("_s", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pc.sort_indices(batch, sort_keys=[(c, "ascending") for c in keys]))
            edges = group_starts(batch, keys)
            heads = batch.take(pa.array(edges[:-1])).select(keys)
            found = []
            for a, b in zip(edges[:-1], edges[1:]):
                part = batch.slice(a, b - a)
                values = np.stack([part.column(s).to_numpy() for s in names])
                found.append((values @ _with_ones(part.column("_w"), n_boot)).tolist())
            yield pa.RecordBatch.from_arrays([*heads.columns, pa.array(found, pa.list_(pa.list_(pa.float64())))], names=schema.names)

    # Sums of a batch are added up before they meet, one number per replicate.
    long = wanted.mapInArrow(run, schema).select(*keys, F.posexplode(F.arrays_zip(*[F.col("_s")[i].alias(s) for i, s in enumerate(names)])).alias("rep", "_v"))
    per_cell = long.groupBy(*keys, "rep").agg(*[F.sum(F.col(f"_v.{s}")).alias(s) for s in names])
    return per_cell.groupBy(*group, "rep").agg(metric.value.alias("value"))


class _Walk:
    """What a replicate has seen of a group, carried from block to block."""

    def __init__(self, start: list[list[float]], step: Callable) -> None:
        self.n, self.x = (np.array(s) for s in start)
        self.gains, self.step = np.zeros(len(self.n)), step

    def add(self, weights: np.ndarray, x: np.ndarray) -> None:
        weights = weights.astype(np.float64)
        xs = weights * x[:, None]
        self.gains += self.step(weights, x, np.cumsum(weights, axis=0) - weights + self.n, np.cumsum(xs, axis=0) - xs + self.x)
        self.n, self.x = self.n + weights.sum(axis=0), self.x + xs.sum(axis=0)


def _ordered(rows: DataFrame, group: list[str], metric: Ordered, row: str, n_boot: int) -> DataFrame:
    """``group, rep, value`` of a metric that walks down an order.

    Rows are range-partitioned once; the weights of each range are added up, and the second pass
    begins every range with what came before it, given to it as the first row of its stream.
    """
    wanted = rows if metric.where is None else rows.where(metric.where)
    parts = ranged(wanted.select(*group, metric.order.cast("double").alias("_u"), F.col(row).alias("_row"),
                                 metric.x.cast("double").alias("_x"), "_w"), group, ["_u", "_row"], costly=True)
    keys = [*group, PID]
    totals = _range_sums(parts, keys, n_boot)
    earlier = Window.partitionBy(*group, "rep").orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "rep", *[F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(c) for c in ("n", "x")])
    start = before.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rep", "n", "x"))).alias("_s")).select(
        *keys, F.array("_s.n", "_s.x").alias("_start"))
    stream = (parts.withColumn("_start", F.lit(None).cast("array<array<double>>"))
              .unionByName(start, allowMissingColumns=True)
              .repartition(spread(parts), *keys).sortWithinPartitions(*keys, F.col("_start").isNull(), "_u", "_row"))
    schema = T.StructType([*[parts.schema[c] for c in group], T.StructField("_g", T.ArrayType(T.DoubleType()))])
    step, limit = metric.step, max((1 << 21) // (n_boot + 1), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, walk = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*head, pa.array([walk.gains.tolist()], pa.list_(pa.float64()))], names=schema.names)
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = group_starts(batch, keys)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if batch.column("_start")[a].is_valid:
                    if walk is not None:
                        yield done()
                    head = [batch.column(c).slice(a, 1) for c in group]
                    walk, a = _Walk(batch.column("_start")[a].as_py(), step), a + 1
                for i in range(a, b, limit):
                    part = batch.slice(i, min(limit, b - i))
                    walk.add(_with_ones(part.column("_w"), n_boot), part.column("_x").to_numpy())
        if walk is not None:
            yield done()

    gains = stream.mapInArrow(run, schema).select(*group, F.posexplode("_g").alias("rep", "g")).groupBy(*group, "rep").agg(F.sum("g").alias("g"))
    weight = totals.groupBy(*group, "rep").agg(F.sum("n").alias("n"))
    joined = gains.withColumnsRenamed({c: f"_of_{c}" for c in [*group, "rep"]})
    same = F.lit(True)
    for c in [*group, "rep"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return weight.join(joined, same).select(*group, "rep", F.try_divide("g", "n").alias("value"))


def _range_sums(parts: DataFrame, keys: list[str], n_boot: int) -> DataFrame:
    """``keys, rep, n, x``: weights, and weights times x, of each range."""
    return materialise(_long_sums(parts, keys, n_boot))


def _long_sums(parts: DataFrame, keys: list[str], n_boot: int) -> DataFrame:
    schema = T.StructType([*[parts.schema[c] for c in keys], *T._parse_datatype_string("_n array<double>, _x array<double>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = group_starts(batch, keys)
            n, x = [], []
            for a, b in zip(edges[:-1], edges[1:]):
                part = batch.slice(a, b - a)
                w = _with_ones(part.column("_w"), n_boot)
                n.append(w.sum(axis=0, dtype=np.float64).tolist())
                x.append((part.column("_x").to_numpy() @ w).tolist())
            heads = batch.take(pa.array(edges[:-1])).select(keys)
            yield pa.RecordBatch.from_arrays([*heads.columns, pa.array(n, pa.list_(pa.float64())), pa.array(x, pa.list_(pa.float64()))], names=schema.names)

    long = parts.select(*keys, "_x", "_w").mapInArrow(run, schema).select(*keys, F.posexplode(F.arrays_zip("_n", "_x")).alias("rep", "_v"))
    return long.groupBy(*keys, "rep").agg(F.sum("_v._n").alias("n"), F.sum("_v._x").alias("x"))


def bootstrap_draws(df: DataFrame, group: Sequence[str], metrics: Mapping[str, Sums | Ordered], row: str = "image_id",
                    strata: Sequence[str] = ("label",), n_boot: int = 1000, seed: int = 0, stratified: bool = True) -> DataFrame:
    """``group, metric, rep, value``; ``rep`` is :data:`POINT` for the rows as they are.

    Replicates keep the size of every ``strata`` of a group, or are Poisson without ``stratified``.
    """
    group = list(group)
    rows = materialise(with_weights(df, [*group, *strata], row, n_boot, seed, stratified))
    out = None
    for name, metric in metrics.items():
        found = _sums(rows, group, metric, n_boot) if isinstance(metric, Sums) else _ordered(rows, group, metric, row, n_boot)
        found = found.select(*group, F.lit(name).alias("metric"), (F.col("rep") + POINT).alias("rep"), "value")
        out = found if out is None else out.unionByName(found)
    return out


def bootstrap(df: DataFrame, group: Sequence[str], metrics: Mapping[str, Sums | Ordered], row: str = "image_id",
              strata: Sequence[str] = ("label",), n_boot: int = 1000, seed: int = 0, alpha: float = 0.05,
              stratified: bool = True) -> DataFrame:
    """``group, metric, value, ci_lo, ci_hi``: point value and percentile interval of every metric.

    Undefined replicates are left out; a metric that is undefined on the rows as they are is NULL.
    """
    keys = [*group, "metric"]
    draws = materialise(bootstrap_draws(df, group, metrics, row, strata, n_boot, seed, stratified))
    points = draws.where(F.col("rep") == POINT).drop("rep")
    ends = percentile_interval(draws.where((F.col("rep") != POINT) & finite(F.col("value"))), keys, "value", alpha)
    ends = ends.withColumnsRenamed({c: f"_of_{c}" for c in keys})
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    known = finite(F.col("value"))
    return points.join(ends, same, "left").select(
        *keys, F.when(known, F.col("value")).alias("value"),
        *[F.when(known, F.col(f"value_{end}")).alias(end) for end in ("ci_lo", "ci_hi")])
