"""Bootstrap of rank metrics, distributed over score ranges.

A replicate gives every row a weight (``plans.replicates``): by default as many rows of each class as
there are, else independent Poisson weights. A cell of tied rows of one class takes their
weights together, so rows are never repeated once per replicate. Cells are range-partitioned by
score; each partition computes its share of the Mann-Whitney statistic for all replicates at
once, and the partitions are combined with the totals of the partitions before them. Weights depend
on the group and on places in its order, so a retried task, or the second pass that average
precision needs, draws the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from surety.plans.joins import bounded
from surety.plans.ranking import PID, group_starts, partition_offsets, ranged, running_sums, spread
from surety.plans.replicates import GOLD, NEGATIVE, Multinomial, poisson_weights, text_key, weights_of
from surety.session import materialise

#: Largest weight matrix (cells x replicates) held at once by a task.
BLOCK = 1 << 19
#: Where a cell begins in its group and in each class, and their sizes.
PLACES = ["_at", "_pos_at", "_pos_of", "_neg_at", "_neg_of"]


def placed(parts: DataFrame, group: list[str], value: str) -> DataFrame:
    """Cells as ``ranking.ranged`` stored them, with their group's key and :data:`PLACES`."""
    sums = ["n", "n_pos"]
    offsets = bounded(partition_offsets(parts, group, sums))
    keys = [*group, PID]
    offsets = offsets.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    at = {s: F.col(f"_{s}_local") + F.col(f"_{s}_offset") for s in sums}
    out = running_sums(parts.select(*group, value, "n", "n_pos", PID), group, sums).join(offsets, same).select(
        *group, value, F.col("n").cast("bigint").alias("n"), F.col("n_pos").cast("bigint").alias("n_pos"), PID,
        text_key(*group).alias("_key"), at["n"].alias("_at"), at["n_pos"].alias("_pos_at"), F.col("n_pos_total").alias("_pos_of"),
        (at["n"] - at["n_pos"]).alias("_neg_at"), (F.col("n_total") - F.col("n_pos_total")).alias("_neg_of"))
    return out.sortWithinPartitions(*group, PID, value)


def _blocks(frame: pd.DataFrame, n_boot: int):
    step = max(BLOCK // max(n_boot, 1), 1)
    for i in range(0, len(frame), step):
        yield frame.iloc[i:i + step]


class Draws:
    """Weights of the two classes of a block of cells; ``kind`` says by which law.

    ``stratified`` and ``poisson`` cells come from :func:`placed`; ``given`` cells are single rows that
    bring their weights along.
    """

    def __init__(self, kind: str, n_boot: int, seed: int) -> None:
        self.kind, self.n_boot, self.seed = kind, n_boot, seed
        self.columns = ["_w", "n_pos"] if kind == "given" else ["_key", "n", "n_pos", *PLACES]
        self.key: int | None = None
        self.classes: list[Multinomial] = []

    def __call__(self, block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        n_pos = block["n_pos"].to_numpy()
        if self.kind == "given":
            w = weights_of(block["_w"], self.n_boot).astype(np.float64)
            return w * (n_pos > 0)[:, None], w * (n_pos == 0)[:, None]
        n_neg, key = block["n"].to_numpy() - n_pos, int(block["_key"].iloc[0])
        if self.kind == "poisson":
            with np.errstate(over="ignore"):
                keys = (np.uint64(key) + block["_at"].to_numpy().astype(np.uint64) * np.uint64(GOLD)).view(np.int64)
            return (poisson_weights(keys, n_pos, self.n_boot, self.seed),
                    poisson_weights(keys ^ np.int64(NEGATIVE), n_neg, self.n_boot, self.seed))
        if key != self.key:
            sizes = block["_pos_of"].iloc[0], block["_neg_of"].iloc[0]
            self.key, self.classes = key, [Multinomial(k, int(m), self.n_boot, self.seed)
                                           for k, m in zip((key, key ^ NEGATIVE), sizes)]
        return tuple(law.weights(block[at].to_numpy(), n).astype(np.float64)
                     for law, at, n in zip(self.classes, ("_pos_at", "_neg_at"), (n_pos, n_neg)))


def _fields(df: DataFrame, group: Sequence[str]) -> list[T.StructField]:
    return [df.schema[c] for c in group]


def _pair_sums(parts: DataFrame, group: list[str], value: str, draws: Draws) -> DataFrame:
    """Per partition and replicate: class weights and the within-partition pair count.

    Rows with a non-NULL ``_edge`` repeat the class weights of the partition's smallest and
    largest value, which may continue in a neighbouring partition.
    """
    array = T.ArrayType(T.DoubleType())
    schema = T.StructType([*_fields(parts, group), T.StructField(PID, T.IntegerType()),
                           T.StructField("_edge", T.DoubleType()), T.StructField("_p", array),
                           T.StructField("_n", array), T.StructField("_u", array)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sums = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = group_starts(batch, [*group, PID])
            for a, b in zip(edges[:-1], edges[1:]):
                piece = batch.slice(a, b - a)
                mine = [piece.column(c)[0].as_py() for c in [*group, PID]]
                if mine != head:
                    if sums is not None:
                        yield sums.rows(head, schema)
                    head, sums = mine, _PairSums(draws)
                sums.add(piece, value)
        if sums is not None:
            yield sums.rows(head, schema)

    return parts.mapInArrow(run, schema)


class _PairSums:
    """Running class weights and pair counts of values that come in ascending order."""

    def __init__(self, draws: Draws) -> None:
        self.draws, self.n_boot = draws, draws.n_boot
        n_boot = draws.n_boot
        self.pos, self.neg, self.pairs = np.zeros(n_boot), np.zeros(n_boot), np.zeros(n_boot)
        self.first: list | None = None      # value, weights of the smallest value
        self.tie: list | None = None        # the same of the value at hand

    def add(self, piece: pa.RecordBatch, value: str) -> None:
        frame = piece.select([value, *self.draws.columns]).to_pandas()
        for block in _blocks(frame, self.n_boot):
            pos, neg = self.draws(block)
            v = block[value].to_numpy()
            starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            if len(starts) < len(v):
                pos, neg, v = np.add.reduceat(pos, starts), np.add.reduceat(neg, starts), v[starts]
            tie_goes_on = self.tie is not None and v[0] == self.tie[0]
            if tie_goes_on:
                # Half of the cross pairs each way; those below were all counted as beaten.
                self.pairs += 0.5 * (self.tie[1] * neg[0] - pos[0] * self.tie[2])
            below = np.cumsum(neg, axis=0) - neg + self.neg
            self.pairs += (pos * (below + 0.5 * neg)).sum(axis=0)
            self.pos, self.neg = self.pos + pos.sum(axis=0), self.neg + neg.sum(axis=0)
            if self.first is None:
                self.first = [v[0], pos[0].copy(), neg[0].copy()]
            elif tie_goes_on and self.first[0] == v[0]:
                self.first = [v[0], self.first[1] + pos[0], self.first[2] + neg[0]]
            if tie_goes_on and len(v) == 1:
                self.tie = [v[0], self.tie[1] + pos[0], self.tie[2] + neg[0]]
            else:
                self.tie = [v[-1], pos[-1].copy(), neg[-1].copy()]

    def rows(self, head: list, schema: T.StructType) -> pa.RecordBatch:
        zero = np.zeros(self.n_boot)
        out = [[*head, None, self.pos, self.neg, self.pairs]]
        ends = {float(end[0]): end for end in (self.first, self.tie)}
        out += [[*head, v, end[1], end[2], zero] for v, end in ends.items()]
        kinds = to_arrow_schema(schema)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], kinds.field(i).type) for i in range(len(kinds))],
            names=kinds.names)


def _per_replicate(df: DataFrame, group: list[str], names: Sequence[str]) -> DataFrame:
    zipped = F.posexplode(F.arrays_zip(*names)).alias("rep", "_z")
    return df.select(*group, PID, "_edge", zipped).select(
        *group, PID, "_edge", "rep", *[F.col(f"_z.{c}").alias(c) for c in names])


def auroc_draws(cells: DataFrame, group: Sequence[str], value: str, n_boot: int, seed: int = 0,
                stratified: bool = True, given: str | None = None, with_ap: bool = False,
                dealt: bool = False) -> DataFrame:
    """One row per group and replicate with ``auroc`` (and ``aupr`` when asked).

    ``cells`` has ``n`` and ``n_pos`` per row, one row per distinct value. With ``given`` rows are
    single observations with their weights in ``_w``, so two scorers of the same images get the same
    resample; ``given`` tells rows of one value apart, which may then span partitions, and the
    edge rows put that right. ``dealt`` says that the cells are as ``ranking.ranged`` stored them.
    """
    group = list(group)
    if given:
        if with_ap:
            raise ValueError("average precision needs one cell per value")
        parts = ranged(cells.select(*dict.fromkeys([*group, value, given]), "n", "n_pos", "_w"), group, [value, given], costly=True)
        draws = Draws("given", n_boot, seed)
    else:
        parts = cells if dealt else ranged(cells.select(*group, value, "n", "n_pos"), group, [value], costly=True)
        parts = placed(parts, group, value)
        draws = Draws("stratified" if stratified else "poisson", n_boot, seed)
    long = _per_replicate(_pair_sums(parts, group, value, draws), group, ["_p", "_n", "_u"])
    if with_ap or given:
        long = materialise(long)
    before = (Window.partitionBy(*group, "rep").orderBy(PID)
              .rowsBetween(Window.unboundedPreceding, -1))
    body = long.where(F.col("_edge").isNull()).withColumn(
        "_below", F.coalesce(F.sum("_n").over(before), F.lit(0.0)))
    totals = body.groupBy(*group, "rep").agg(
        F.sum(F.col("_u") + F.col("_p") * F.col("_below")).alias("_u"),
        F.sum("_p").alias("_pos"), F.sum("_n").alias("_neg"))
    if given:
        same = Window.partitionBy(*group, "rep", "_edge")
        earlier = same.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
        edges = long.where(F.col("_edge").isNotNull()).withColumns({
            "_lower": F.coalesce(F.sum("_n").over(earlier), F.lit(0.0)),
            "_all": F.sum("_n").over(same)})
        fix = edges.groupBy(*group, "rep").agg(F.sum(
            F.col("_p") * F.lit(0.5)
            * ((F.col("_all") - F.col("_lower") - F.col("_n")) - F.col("_lower"))).alias("_fix"))
        totals = totals.join(fix, [*group, "rep"], "left").withColumn(
            "_u", F.col("_u") + F.coalesce("_fix", F.lit(0.0)))
    valid = (F.col("_pos") > 0) & (F.col("_neg") > 0)
    out = totals.select(*group, "rep", "_pos", F.when(
        valid, F.col("_u") / (F.col("_pos") * F.col("_neg"))).alias("auroc"))
    if not with_ap:
        return out.drop("_pos")
    ap = _precision_sums(parts, body, group, value, draws)
    return out.join(ap, [*group, "rep"]).select(
        *group, "rep", "auroc",
        F.when(F.col("auroc").isNotNull(), F.col("_ap") / F.col("_pos")).alias("aupr"))


def _precision_sums(parts: DataFrame, body: DataFrame, group: list[str], value: str, draws: Draws) -> DataFrame:
    """Average-precision numerators: a second pass that knows the classes above each range.

    Cells of a range pass in descending order, and what stands above the range comes as the first
    row of its stream, so no range is ever held whole.
    """
    after = (Window.partitionBy(*group, "rep").orderBy(F.col(PID).desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    above = body.select(
        *group, PID, "rep",
        F.coalesce(F.sum("_p").over(after), F.lit(0.0)).alias("_pa"),
        F.coalesce(F.sum("_n").over(after), F.lit(0.0)).alias("_na"))
    above = above.groupBy(*group, PID).agg(
        F.sort_array(F.collect_list(F.struct("rep", "_pa", "_na"))).alias("_s")).select(
        *group, PID, F.array("_s._pa", "_s._na").alias("_start"))
    keys = [*group, PID]
    stream = (parts.withColumn("_start", F.lit(None).cast("array<array<double>>"))
              .unionByName(above, allowMissingColumns=True).repartition(spread(parts), *keys)
              .sortWithinPartitions(*keys, F.col("_start").isNull(), F.col(value).desc()))
    schema = T.StructType([*_fields(parts, group), T.StructField("_a", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, walk = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = group_starts(batch, keys)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if batch.column("_start")[a].is_valid:
                    if walk is not None:
                        yield walk.row(head, schema)
                    head, walk = [batch.column(c)[a].as_py() for c in group], _Precision(batch.column("_start")[a].as_py(), draws)
                    a += 1
                if a < b:
                    walk.add(batch.slice(a, b - a))
        if walk is not None:
            yield walk.row(head, schema)

    return (stream.mapInArrow(run, schema).select(*group, F.posexplode("_a").alias("rep", "_v"))
            .groupBy(*group, "rep").agg(F.sum("_v").alias("_ap")))


class _Precision:
    """Running average-precision numerators of cells that come in descending order."""

    def __init__(self, start: list[list[float]], draws: Draws) -> None:
        self.tp, self.fp = (np.array(s) for s in start)
        self.total, self.draws = np.zeros(draws.n_boot), draws

    def add(self, piece: pa.RecordBatch) -> None:
        for block in _blocks(piece.select(self.draws.columns).to_pandas(), self.draws.n_boot):
            pos, neg = self.draws(block)
            hits = self.tp + np.cumsum(pos, axis=0)
            seen = hits + self.fp + np.cumsum(neg, axis=0)
            self.total += (pos * hits / np.maximum(seen, 1.0)).sum(axis=0)
            self.tp, self.fp = self.tp + pos.sum(axis=0), self.fp + neg.sum(axis=0)

    def row(self, head: list, schema: T.StructType) -> pa.RecordBatch:
        kinds = to_arrow_schema(schema)
        return pa.RecordBatch.from_arrays([pa.array([v], kinds.field(i).type) for i, v in enumerate([*head, self.total])], names=kinds.names)


def percentile_intervals(draws: DataFrame, group: Sequence[str], columns: Sequence[str],
                         alpha: float = 0.05) -> DataFrame:
    """:func:`percentile_interval` of several columns, read from the draws once."""
    ends = {"lo": alpha / 2, "hi": 1 - alpha / 2}
    q = [F.percentile(c, F.array(*[F.lit(p) for p in ends.values()])).alias(f"_q_{c}") for c in columns]
    return draws.groupBy(*group).agg(*q).select(
        *group, *[F.col(f"_q_{c}")[i].alias(f"{c}_ci_{end}") for c in columns for i, end in enumerate(ends)])


def percentile_interval(draws: DataFrame, group: Sequence[str], column: str,
                        alpha: float = 0.05) -> DataFrame:
    """Percentile interval over the valid replicates (``n_boot`` values per group)."""
    q = F.percentile(column, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return (draws.where(F.col(column).isNotNull()).groupBy(*group).agg(q.alias("_q"))
            .select(*group, F.col("_q")[0].alias(f"{column}_ci_lo"),
                    F.col("_q")[1].alias(f"{column}_ci_hi")))
