"""Bottom-k sketches: the first rows of every group in one pass.

A sketch holds the ``n`` smallest rows of each group it has seen. Sketches of parts of a table
merge into the sketch of the whole, so every task prunes its own rows before anything is shuffled,
neighbouring tasks merge what is left, and only then do at most ``n`` rows for each of ``MERGERS``
sketches of a group meet. Nothing is sorted globally, nothing is stored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.plans.ranking import group_starts

#: Rows and bytes that a sketch gathers before it prunes; what still is above them is passed on.
HELD_ROWS, HELD_BYTES = 100_000, 64 << 20
#: A group's rows meet in so many sketches before they meet in one.
MERGERS = 32
DRAW = "_draw"


class Sketch:
    """The ``n`` smallest rows of each group of the batches given so far."""

    def __init__(self, group: Sequence[str], order: Sequence[str], n: int) -> None:
        self.group, self.order, self.n = list(group), list(order), n
        self.held: list[pa.RecordBatch] = []

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.held.append(batch)
        if self._full():
            self.held = [self._pruned()]
            # Many small groups: nothing more to drop here, so later merges go on.
            if 2 * self.held[0].num_rows > HELD_ROWS or 2 * self.held[0].nbytes > HELD_BYTES:
                yield from self.rest()

    def _full(self) -> bool:
        return sum(b.num_rows for b in self.held) > HELD_ROWS or sum(b.nbytes for b in self.held) > HELD_BYTES

    def _pruned(self) -> pa.RecordBatch:
        rows = pa.Table.from_batches(self.held).combine_chunks().to_batches()[0]
        keys = [(c, "ascending") for c in [*self.group, *self.order]]
        rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start")) if keys else rows
        starts = group_starts(rows, self.group)
        place = np.arange(rows.num_rows) - np.repeat(starts[:-1], np.diff(starts))
        return rows.filter(pa.array(place < self.n))

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            rows = self._pruned()
            self.held = []
            if rows.num_rows:
                yield rows


def _sortable(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with a column that puts NaN last before each column of floats in ``order``."""
    keys, added = [], {}
    for i, name in enumerate(order):
        if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
            added[f"_nan{i}"] = F.coalesce(F.isnan(F.col(f"`{name}`")), F.lit(False))
            keys.append(f"_nan{i}")
        keys.append(name)
    return df.withColumns(added) if added else df, keys


def _pruned(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(group, order, n)
        for batch in batches:
            if batch.num_rows:
                yield from sketch.add(batch)
        yield from sketch.rest()

    return df.mapInArrow(run, df.schema)


def _merged(sketches: DataFrame, group: list[str], order: list[str], n: int, position: str) -> DataFrame:
    """The ``n`` first rows of each group, from sketches of its parts."""
    part = F.pmod(F.spark_partition_id(), F.lit(MERGERS))
    met = _pruned(sketches.withColumn("_part", part).repartition(*group, "_part"), [*group, "_part"], order, n)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return met.withColumn(position, place).where(F.col(position) <= n)


def first_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int,
               position: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group, optionally with their 1-based ``position``.

    NULL comes first in ``order`` and NaN last, as in a Spark sort; a NULL in ``group`` is a group
    like others. ``n`` rows of a group meet in one task, whatever the size of the group.
    """
    name = position or "_position"
    rows, keys = _sortable(df, order)
    out = _merged(_pruned(rows, group, keys, n), list(group), keys, n, name)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *([name] if position else []))


def draws(df: DataFrame, group: Sequence[str], orders: Sequence[Column], row: str, n: int,
          rep: str = "rep", position: str = DRAW) -> DataFrame:
    """The first ``n`` rows of each group under every one of ``orders``, in one pass over ``df``.

    ``orders`` are numbers between 0 and 1, ties go by ``row``. All sketches are filled side by
    side, so rows are not copied once per order before they are pruned. The prefixes of a draw
    are the draws of every smaller size.
    """
    names, columns = [f"_u{i}" for i in range(len(orders))], df.columns
    rows = df.withColumns(dict(zip(names, orders)))
    schema = T.StructType([*df.schema.fields, T.StructField(rep, T.IntegerType()), T.StructField("_u", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = [Sketch(group, ["_u", row], n) for _ in names]
        for batch in batches:
            if batch.num_rows:
                for i, (name, sketch) in enumerate(zip(names, sketches)):
                    values = [*[batch.column(c) for c in columns], pa.array(np.full(batch.num_rows, i, np.int32)), batch.column(name)]
                    yield from sketch.add(pa.RecordBatch.from_arrays(values, names=schema.names))
        for sketch in sketches:
            yield from sketch.rest()

    return _merged(rows.mapInArrow(run, schema), [rep, *group], ["_u", row], n, position).drop("_part", "_u")
