"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are cut into two halves. Each half has its own codebook (k-means, fitted in the driver
on at most ``TRAIN_VECTORS`` vectors chosen by hash), and a pair of codes is a cell of a product
grid. Every vector is indexed in its cell. Every vector is also a query: the codes of each half are
sorted by a lower bound of the squared distance to anything on their side, and the multi-sequence
traversal takes pairs of codes by the sum of both bounds, nearest first, until the next cell is
farther than the cosine threshold allows. The bound of one half is how far the query is from the
code's side of the planes between codes, so the cells left out hold no link: the recall that is
aimed at is 1. Only vectors of visited cells are compared, in double precision.

Runs of ``PART_CELLS`` neighbouring cells are kept together, so a query that visits several of them
is sent once, with the list of the cells it visits there.

Only vectors of one label are compared. Equal vectors are collapsed first and count with their
number. A cell's vectors are cut into blocks and its queries into shares, each of bounded size, and
every pair of a block and a share is a group of its own, so a cell that holds a third of all rows is
spread out. A group returns counts, and a spanning set of links, never all pairs.

Defined results: vectors that are NULL, empty, zero, or hold NULL or non-finite components, and
rows with NULL label, have no links and are components of their own; vectors of different lengths
are never linked; a NULL ``vec_id`` takes part but is not the smallest id of a component that has
another; repeated rows link with each other; an empty table gives no rows. Vectors are told apart
by a 64-bit hash of label and components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.llm.common import arrow_map, components, local_roots, sorted_runs, stream_groups
from surety.session import materialise

COSINE = 0.98
TRAIN_VECTORS = 20_000
#: Vectors that a cell of the grid should hold on average.
CELL_VECTORS = 16
MOST_CODES = 1024
BLOCK, SHARE = 2048, 4096
#: Neighbouring cells that are kept together, about a block of vectors.
PART_CELLS = BLOCK // CELL_VECTORS


def k_means(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Codebook of at most ``k`` codes."""
    x = np.unique(x, axis=0)
    codes = x[np.random.default_rng(0).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = (np.square(codes).sum(1) - 2 * x @ codes.T).argmin(1)
        count = np.bincount(near, minlength=len(codes))
        sums = np.zeros_like(codes)
        np.add.at(sums, near, x)
        codes = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], codes)
    return np.unique(codes, axis=0)


@dataclass
class MultiIndex:
    """Codebooks of the two halves; vectors of another length than ``size`` share one cell."""

    left: np.ndarray
    right: np.ndarray
    size: int
    cosine: float = COSINE

    def halves(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(x[:, :self.size // 2], self.left), (x[:, self.size // 2:], self.right)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each unit vector."""
        i, j = ((np.square(c).sum(1) - 2 * h @ c.T).argmin(1) for h, c in self.halves(x))
        return i * len(self.right) + j

    @staticmethod
    def bounds(half: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Lower bound of the squared distance from each row to the region of each code."""
        d = np.square(half[:, None, :] - codes[None]).sum(2)
        apart = np.sqrt(np.square(codes[:, None] - codes[None]).sum(2))
        np.fill_diagonal(apart, np.inf)
        # Beyond the plane between code k and code i, when k is nearer: the depth behind that plane.
        behind = (d[:, :, None] - d[:, None, :]) / (2 * apart)[None]
        return np.square(np.maximum(behind.max(2), 0.0))

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, cell)`` of every cell that a link of the row can lie in, nearest first."""
        limit = 2 * (1 - self.cosine) + 1e-9
        rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, 4_000_000 // (len(self.left) ** 2 + len(self.right) ** 2))
        for first in range(0, len(x), step):
            (near_a, a), (near_b, b) = (_sorted_rows(self.bounds(h, c)) for h, c in self.halves(x[first:first + step]))
            row, i, j = multi_sequence(a, b, limit)
            rows.append(first + row)
            found.append(near_a[row, i] * len(self.right) + near_b[row, j])
        row, cell = np.concatenate(rows), np.concatenate(found)
        order = np.argsort(row, kind="stable")
        return row[order], cell[order]


def _sorted_rows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = bounds.argsort(1, kind="stable")
    return order, np.take_along_axis(bounds, order, 1)


def multi_sequence(a: np.ndarray, b: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, i, j)`` with ``a[row, i] + b[row, j] <= limit``, for each row in increasing order of the sum.

    Both inputs are sorted along their rows. Each row keeps, for every ``i``, the first ``j`` not yet
    taken; all rows take their nearest pair in one step and leave once it lies beyond the limit.
    """
    rows = np.arange(len(a))
    # One infinite column more: behind the last code of the other half nothing is left.
    b = np.concatenate([b, np.full((len(b), 1), np.inf)], 1)
    upto = np.zeros(a.shape, np.int64)
    total = a + b[:, :1]
    taken: list[tuple] = [(np.zeros(0, np.int64),) * 3]
    while len(rows):
        i = total.argmin(1)
        at = np.arange(len(rows))
        go_on = total[at, i] <= limit
        if not go_on.all():
            rows, a, b, upto, total, i = (v[go_on] for v in (rows, a, b, upto, total, i))
            at = np.arange(len(rows))
        taken.append((rows, i, upto[at, i]))
        upto[at, i] += 1
        total[at, i] = a[at, i] + b[at, upto[at, i]]
    return tuple(map(np.concatenate, zip(*taken)))


def _unit(flat: np.ndarray, size: int) -> np.ndarray:
    x = flat.reshape(-1, size).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)         # squares neither overflow nor vanish
    return x / np.sqrt(np.square(x).sum(1, keepdims=True))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``(node, label, vector, n, low)``: distinct usable vectors, their number, their smallest id."""
    v = F.col("embedding")
    number = F.transform(v, lambda x: F.coalesce(x, F.lit(float("nan"))))
    good = (F.size(v) > 0) & ~F.exists(number, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(number, lambda x: x != 0)
    usable = rows.where(F.col("label").isNotNull() & v.isNotNull()).where(good)
    return usable.groupBy("node", "label").agg(F.first("embedding").alias("vector"), F.count("*").alias("n"), F.min("vec_id").alias("low"))


def fit(vectors: DataFrame, cosine: float = COSINE, most: int = TRAIN_VECTORS) -> MultiIndex | None:
    """Fit the codebooks on a bounded sample; their number follows the largest label."""
    common = vectors.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if common is None:
        return None
    size = common["size"]
    largest = vectors.groupBy("label").count().agg(F.max("count")).first()[0]
    k = min(MOST_CODES, max(2, math.ceil(math.sqrt(largest / CELL_VECTORS))))
    rows = vectors.where(F.size("vector") == size).orderBy("node").select("vector").limit(most).collect()
    x = _unit(np.array([r[0] for r in rows]), size)
    return MultiIndex(k_means(x[:, :size // 2], k), k_means(x[:, size // 2:], k), size, cosine)


def _placed(index: MultiIndex, query: bool):
    """Rows of the index (``cells``: their own) or of the queries (those visited), by runs of cells."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = batch.column("vector")
        sizes = np.diff(vectors.offsets.to_numpy())
        fit_size = np.flatnonzero(sizes == index.size)
        odd = np.flatnonzero(sizes != index.size)
        x = _unit(vectors.take(pa.array(fit_size)).flatten().to_numpy(), index.size) if len(fit_size) else np.zeros((0, index.size))
        at, cell = index.visits(x) if query else (np.arange(len(x)), index.cells(x))
        row = np.concatenate([fit_size[at], odd])
        cell = np.concatenate([cell, -sizes[odd]]).astype(np.int64)
        area = np.where(cell < 0, cell, cell // PART_CELLS)
        order = np.lexsort((area, row))                     # stable: cells of a run stay nearest first
        row, cell, area = row[order], cell[order], area[order]
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (area[1:] != area[:-1]))[:len(row)])
        cells = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)), pa.int32()), pa.array(cell))
        picked = batch.take(pa.array(row[new]))
        return pa.RecordBatch.from_arrays([*picked.columns, pa.array(area[new]), cells], names=[*picked.schema.names, "area", "cells"])
    return run


def _links(x: np.ndarray, cell: np.ndarray, visitor: np.ndarray, visited: np.ndarray, cosine: float):
    """``(query, stored)`` rows of ``x`` with links: each query against the stored rows of cells it visits."""
    stored = np.argsort(cell, kind="stable")
    order = np.argsort(visited, kind="stable")
    visitor, visited = visitor[order], visited[order]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    starts = sorted_runs(cell[stored])
    for a, b in zip(starts[:-1], starts[1:]):
        inside = stored[a:b]
        lo, hi = np.searchsorted(visited, [cell[inside[0]], cell[inside[0]] + 1])
        if lo < hi:
            q, s = np.nonzero(x[visitor[lo:hi]] @ x[inside].T >= cosine)
            left.append(visitor[lo:hi][q])
            right.append(inside[s])
    return np.concatenate(left), np.concatenate(right)


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, values)`` of a list column."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)


def _compare(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in stream_groups(batches, "part"):
            part, query = table.column("part").to_numpy(), table.column("query").to_numpy()
            offsets, flat = _lists(table.column("vector"))
            cell_at, cells = _lists(table.column("cells"))
            node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
            out: list[list] = [[] for _ in range(3)]
            starts = sorted_runs(part)
            for a, b in zip(starts[:-1], starts[1:]):
                border = a + int((query[a:b] == 0).sum())
                if border in (a, b):
                    continue
                x = _unit(flat[offsets[a]:offsets[b]], offsets[a + 1] - offsets[a])
                visitor = np.repeat(np.arange(border - a, b - a), np.diff(cell_at[border:b + 1]))
                left, right = _links(x, cells[cell_at[a:border]], visitor, cells[cell_at[border]:cell_at[b]], cosine)
                real = node[a + left] != node[a + right]
                left, right = left[real], right[real]
                if not len(left):
                    continue
                links = np.bincount(left, weights=n[a + right], minlength=b - a).astype(np.int64)
                # The same vector may be a query and an indexed row: one number for both.
                names, who = np.unique(node[a:b], return_inverse=True)
                roots = local_roots(len(names), who[left], who[right])
                linked = np.flatnonzero(links)
                for column, value in zip(out, (node[a:b][linked], links[linked], names[roots[who[linked]]])):
                    column.append(value)
                tied = np.unique(who[right])
                for column, value in zip(out, (names[tied], np.zeros(len(tied), np.int64), names[roots[tied]])):
                    column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["node", "links", "root"])
    return run


def link_counts(vectors: DataFrame, index: MultiIndex, block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """``(node, links, root)``: rows to add up per node, and links from node to root."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    stored = arrow_map(vectors, _placed(index, False), f"{fields}, area bigint, cells array<bigint>")
    asking = arrow_map(vectors, _placed(index, True), f"{fields}, area bigint, cells array<bigint>")
    in_area = stored.groupBy("label", "area").agg(F.count("*").alias("held"))
    sizes = materialise(in_area.join(asking.groupBy("label", "area").agg(F.count("*").alias("asked")), ["label", "area"]))
    blocks = F.ceil(F.col("held") / block).cast("int")
    shares = F.ceil(F.col("asked") / share).cast("int")
    own = F.pmod(F.xxhash64("node"), F.lit(1 << 30))

    def dealt(rows: DataFrame, query: int) -> DataFrame:
        """A vector goes to its block for every share, a query to its share for every block."""
        mine, others = (F.pmod(own, shares), blocks) if query else (F.pmod(own, blocks), shares)
        part = F.transform(F.sequence(F.lit(0), others - 1), lambda o: F.xxhash64(
            "label", "area", *((o, mine.cast("int")) if query else (mine.cast("int"), o))))
        return rows.join(sizes, ["label", "area"]).select(
            "node", "vector", "n", "cells", F.lit(query).alias("query"), F.explode(part).alias("part"))

    return (dealt(stored, 0).unionByName(dealt(asking, 1)).repartition("part").sortWithinPartitions("part", "query")
            .mapInArrow(_compare(index.cosine), "node bigint, links bigint, root bigint"))


def near_duplicates(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``rows(vec_id, embedding, label)``."""
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding"), F.col("label"))
    # The hash skips NULL components; as NaN they count, and no usable vector has one.
    rows = rows.withColumn("node", F.xxhash64("label", F.transform("embedding", lambda x: F.coalesce(x, F.lit(float("nan"))))))
    vectors = materialise(distinct_vectors(rows))
    index = fit(vectors, cosine)
    if index is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    found = materialise(link_counts(vectors, index))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = (vectors.select("node", "n", "low").join(links, "node", "left").join(groups, "node", "left")
             .select("node", "n", "low", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")))
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    named = known.join(lowest, "root").select("node", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    # Rows that take no part share a node only with rows like them; they are told by their own state.
    out = rows.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
