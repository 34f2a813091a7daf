"""Ordered prefix sums without putting a group in one task.

Every rank, order statistic, cumulative curve and "how many are at least this large" count in
the library goes through :func:`prefix_sums`. Rows are range-partitioned on ``(group, order)``,
so one dominant group is spread over many partitions; each partition needs only the sum of the
partitions before it. Ties are collapsed first (:func:`ranked_cells`), so a value that holds a
third of all rows is a single cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.functions.columns import finite
from surety.plans.joins import bounded
from surety.session import materialise

PID = "_pid"
POOLED = "POOLED"


def spread(df: DataFrame) -> int:
    """Partitions for rows that are small but costly: all shuffle partitions, however few bytes each gets."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, group: Sequence[str], order: Sequence[str],
           descending: bool = False, costly: bool = False, keep_order: bool = True) -> DataFrame:
    """Range-partition and sort on ``(group, order)``; the partition number is in ``_pid``.

    The result is materialised: the boundaries are sampled, so the partition number must be
    read back rather than computed a second time. The stored partitions keep their order.
    ``costly`` rows are not gathered into fewer partitions where they are few bytes. Without
    ``keep_order`` the ``order`` columns are left out once the rows stand in their order.
    """
    keys = [F.col(c).asc() for c in group]
    keys += [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    dealt = df.repartitionByRange(*([spread(df)] if costly else []), *keys).withColumn(PID, F.spark_partition_id())
    dealt = dealt.sortWithinPartitions(*keys)
    return materialise(dealt if keep_order else dealt.drop(*order))


def partition_offsets(parts: DataFrame, group: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Per ``(group, _pid)`` sums of all earlier partitions, and the group total.

    There is one row per group and range partition, so the windows stay small.
    """
    earlier = (Window.partitionBy(*group).orderBy(PID)
               .rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy(*group)
    per_part = parts.groupBy(*group, PID).agg(*[F.sum(s).alias(s) for s in sums])
    return per_part.select(
        *group, PID,
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_{s}_offset") for s in sums],
        *[F.sum(s).over(whole).alias(f"{s}_total") for s in sums],
    )


def prefix_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: Sequence[str],
                descending: bool = False, costly: bool = False, keep_order: bool = True) -> DataFrame:
    """Add ``<s>_before`` (sum over strictly earlier rows of the group) and ``<s>_total``.

    ``order`` must identify a row within its group. A NULL in ``group`` is a value like others.
    Without ``keep_order`` the result has no ``order`` columns, and they are not stored either.
    """
    return prefix_of(ranged(df, group, order, descending, costly, keep_order), group, sums)


def group_starts(batch: pa.RecordBatch, group: Sequence[str]) -> np.ndarray:
    """Positions at which another group begins; NULL equals NULL."""
    opens = np.zeros(batch.num_rows, dtype=bool)
    for name in group:
        codes = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy()
        opens[1:] |= codes[1:] != codes[:-1]
    opens[0] = True
    return np.append(np.flatnonzero(opens), batch.num_rows)


def running_sums(parts: DataFrame, group: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Add ``_<s>_local``: sums over the earlier rows of the group in the same range partition.

    Rows come as :func:`ranged` stored them. Each batch is summed as it passes, and only the sums
    of the group at hand are carried to the next one, so nothing is shuffled or sorted again.
    """
    floats = {f.name: isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))
              for f in parts.schema.fields if f.name in sums}
    added = [T.StructField(f"_{s}_local", T.DoubleType() if floats[s] else T.LongType())
             for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, dict.fromkeys(sums, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = group_starts(batch, group)
            lengths = np.diff(edges)
            head = tuple(batch.column(g)[0].as_py() for g in group)
            columns = []
            for s in sums:
                values = batch.column(s).cast(pa.float64() if floats[s] else pa.int64())
                values = values.fill_null(0).to_numpy(zero_copy_only=False)
                start = carried[s] if head == last else 0
                if floats[s]:
                    # Summed group by group, so that no group feels the size of another's sum.
                    before = np.empty(len(values))
                    for a, b in zip(edges[:-1], edges[1:]):
                        before[a] = start if a == 0 else 0.0
                        np.cumsum(values[a:b - 1], out=before[a + 1:b])
                        before[a + 1:b] += before[a]
                else:
                    running = np.cumsum(values) - values
                    before = running - np.repeat(running[edges[:-1]], lengths)
                    before[:lengths[0]] += start
                carried[s] = before[-1] + values[-1]
                columns.append(pa.array(before))
            last = tuple(batch.column(g)[batch.num_rows - 1].as_py() for g in group)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns],
                names=[*batch.schema.names, *[f"_{s}_local" for s in sums]])

    return parts.mapInArrow(run, T.StructType([*parts.schema.fields, *added]))


def prefix_of(parts: DataFrame, group: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """:func:`prefix_sums` of rows that :func:`ranged` has already partitioned."""
    # Stored, so that its size is known before the join and small ones leave the rows where they are.
    offsets = bounded(partition_offsets(parts, group, sums))
    keys = [*group, PID]
    offsets = offsets.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    joined = running_sums(parts, group, sums).join(offsets, same)
    return joined.withColumns(
        {f"{s}_before": F.col(f"_{s}_local") + F.col(f"_{s}_offset") for s in sums}
    ).drop(PID, *[f"_of_{k}" for k in keys], *[f"_{s}_local" for s in sums],
           *[f"_{s}_offset" for s in sums])


def cells(df: DataFrame, group: Sequence[str], value: str,
          sums: Mapping[str, Column]) -> DataFrame:
    """Collapse rows with a finite ``value`` to one row per distinct ``(group, value)``."""
    return (df.where(finite(F.col(value)))
            .groupBy(*group, value)
            .agg(*[F.sum(c).alias(name) for name, c in sums.items()]))


def ranked_cells(df: DataFrame, group: Sequence[str], value: str,
                 sums: Mapping[str, Column]) -> DataFrame:
    """:func:`cells` with ``<s>_before`` and ``<s>_total`` for every sum, in ascending order."""
    return ranked_parts(df, group, value, sums)[0]


def ranked_parts(df: DataFrame, group: Sequence[str], value: str,
                 sums: Mapping[str, Column], costly: bool = False) -> tuple[DataFrame, DataFrame]:
    """:func:`ranked_cells` together with the materialised cells it was computed from."""
    parts = ranged(cells(df, group, value, sums), group, [value], costly=costly)
    return prefix_of(parts, group, list(sums)), parts


def with_pooled(df: DataFrame, column: str = "category", name: str = "group") -> DataFrame:
    """Fan each row out to its own group and to the ``POOLED`` group.

    Always followed by an aggregation that combines on the map side, so what is shuffled does
    not double.
    """
    return df.withColumn(name, F.explode(F.array(F.col(column).cast("string"), F.lit(POOLED))))


def order_statistics(ranking: DataFrame, group: Sequence[str], value: str,
                     ranks: Mapping[str, Column], n: str = "n") -> DataFrame:
    """Per group, the value at each 1-based rank (NULL when the rank is beyond the group).

    ``ranking`` comes from :func:`ranked_cells` in ascending order with a count column ``n``;
    the rank expressions may use ``<n>_total``.
    """
    upto = F.col(f"{n}_before") + F.col(n)
    return ranking.groupBy(*group).agg(
        F.max(f"{n}_total").alias(f"{n}_total"),
        *[F.min(F.when(upto >= rank, F.col(value))).alias(name)
          for name, rank in ranks.items()])


def quantiles(ranking: DataFrame, group: Sequence[str], value: str,
              probabilities: Mapping[str, float], n: str = "n") -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per probability."""
    last = F.col(f"{n}_total") - 1
    ranks: dict[str, Column] = {}
    for name, q in probabilities.items():
        ranks[f"{name}__lo"] = F.floor(F.lit(float(q)) * last) + 1
        ranks[f"{name}__hi"] = F.ceil(F.lit(float(q)) * last) + 1
    stats = order_statistics(ranking, group, value, ranks, n)
    out = []
    for name, q in probabilities.items():
        position = F.lit(float(q)) * last
        lo, hi = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        out.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return stats.select(*group, F.col(f"{n}_total"), *out)


def average_rank(n: str = "n") -> Column:
    """Mean rank of a tie group from an ascending :func:`ranked_cells`."""
    return F.col(f"{n}_before") + (F.col(n) + F.lit(1.0)) / F.lit(2.0)
