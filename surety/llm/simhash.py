"""SimHash near-duplicate groups by a segment-popcount embedding.

Every text gets a 64-bit SimHash of its word shingles. To find fingerprints at most ``BITS``
bits apart, a fingerprint is mapped to the vector of bit counts of its 32 two-bit segments. One
differing bit moves that vector by one in Manhattan distance, so the Manhattan distance is a
lower bound of the Hamming distance, and fingerprints within two bits lie within Manhattan
distance two. The range join runs on a grid: the 32 coordinates are split into six groups; a
pair at distance two or less can differ in two groups at most, so it agrees in all coordinates
of at least one choice of four groups. Each choice is a grid whose cells are join keys. Pairs in
a cell are verified by the exact number of differing bits.

Only distinct fingerprints are joined: copies share one. Within a cell no pairs are written;
each fingerprint is linked with the root of its verified group in the cell. A cell with more than
``CELL_ROWS`` fingerprints is cut into blocks, and each pair of blocks is a task group of its own.

Defined results: NULL text is empty; texts without a word have fingerprint zero and are linked
like any other; a NULL ``doc_id`` is kept, takes part, and never is the smallest id of a group
unless all ids of it are NULL; repeated rows stay repeated; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.llm.common import arrow_map, components, free_name, local_roots, schema_with, sorted_runs, stream_groups, whole_text
from surety.session import materialise

SHINGLE_WORDS = 3
SEED = 42
#: Largest number of differing bits of linked fingerprints; the grid below is built for two.
BITS = 2
CELL_ROWS = 4096
#: Six groups of two-bit segments, as (first bit, last bit + 1).
GROUPS = [(0, 10), (10, 20), (20, 30), (30, 40), (40, 52), (52, 64)]
LOW_BITS = 0x5555555555555555


def simhash(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one UTF-8 text; A-Z and ASCII white space are as bytes define them."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(parts) - words + 1, 1)
    spans = zip(starts[:last].tolist(), ends[min(words, len(parts)) - 1:].tolist())
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        block = hashes[i:i + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, out: str = "fingerprint", words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, <out> bigint)``: the fingerprint's 64 bits as a signed number."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([simhash(t, words) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", out])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")),
                     run, f"doc_id bigint, {out} bigint")


def _cells(fp: Column) -> Column:
    """The 15 grid cells of a fingerprint, as hashes of its bit counts in four of six groups."""
    def word(mask: int) -> Column:
        return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint")

    # Bit counts of the two-bit segments, each written in its two bits.
    other = F.shiftrightunsigned(fp, 1)
    both, one = (x.bitwiseAND(word(LOW_BITS)) for x in (fp.bitwiseAND(other), fp.bitwiseXOR(other)))
    counts = F.shiftleft(both, 1).bitwiseOR(one)
    keys = []
    for number, chosen in enumerate(combinations(GROUPS, len(GROUPS) - BITS)):
        mask = reduce(lambda m, g: m | ((1 << g[1]) - (1 << g[0])), chosen, 0)
        keys.append(F.xxhash64(F.lit(number), counts.bitwiseAND(word(mask))))
    return F.array(*keys)


def _links_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links of each cell, as (fingerprint, root of its group in the cell)."""
    for table in stream_groups(batches, "cell"):
        cell, fp = table.column("cell").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        starts = sorted_runs(cell)
        sizes = np.diff(starts)
        left, right = [], []
        # Small cells: compare rows k apart in the whole table at once; large ones block by block.
        small = np.repeat(sizes <= 64, sizes)
        run = np.repeat(np.arange(len(sizes)), sizes)
        for k in range(1, min(64, int(sizes.max()))):
            i = np.flatnonzero((run[k:] == run[:-k]) & small[:-k])
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= BITS]
            left.append(i)
            right.append(i + k)
        for a, n in zip(starts[:-1][sizes > 64], sizes[sizes > 64]):
            x = fp[a:a + n]
            for j in range(0, n, 256):
                p, q = np.nonzero(np.bitwise_count(x[j:j + 256, None] ^ x[None, :]) <= BITS)
                keep = p + j < q
                left.append(a + j + p[keep])
                right.append(a + q[keep])
        left, right = np.concatenate([*left, []]).astype(np.int64), np.concatenate([*right, []]).astype(np.int64)
        roots = local_roots(len(fp), left, right)
        linked = np.flatnonzero(roots != np.arange(len(fp)))
        if len(linked):
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp[linked].view(np.int64)), pa.array(fp[roots[linked]].view(np.int64))], names=["a", "b"])


def fingerprint_links(fps: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints, closed under reachability at ``BITS`` bits.

    ``fps`` has one column ``fp`` without repeats. Not every linked pair is listed, but every
    linked pair is connected by the rows returned, and every row is connected by links.
    """
    keyed = fps.select("fp", F.explode(_cells(F.col("fp"))).alias("cell"))
    shared = keyed.groupBy("cell").count().where("count > 1")
    found = keyed.join(shared, "cell")
    blocks = F.ceil(F.col("count") / cell_rows).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    # A block meets every block of its cell, itself included: (smaller number, larger number).
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.xxhash64(
        F.col("cell"), F.least(mine, other), F.greatest(mine, other)))
    found = found.select("fp", F.explode(F.when(blocks == 1, F.array("cell")).otherwise(meets)).alias("cell"))
    return (found.repartition("cell").sortWithinPartitions("cell", "fp")
            .mapInArrow(_links_in_cells, "a bigint, b bigint"))


def _classes(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, fp, root, component_id)``; ``root`` is one fingerprint of the group."""
    rows = materialise(fingerprints(docs, "fp", words))
    lowest = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    grouped = components(fingerprint_links(lowest.select("fp")))
    class_of = (lowest.join(grouped.withColumnRenamed("node", "fp"), "fp", "left")
                .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    smallest = class_of.groupBy("root").agg(F.min("low").alias("component_id"))
    named = class_of.join(smallest, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every document.

    ``fingerprint`` is 16 lower-case hex digits, ``component_id`` the smallest id reachable over
    fingerprints at most two bits apart.
    """
    return _classes(docs, words).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """One document of each near-duplicate group, with the columns of ``docs``.

    The smallest ``doc_id`` of the group stays (the smaller fingerprint if two texts share that
    id, and one of rows that repeat both); a NULL id stays only where the group has no other.
    """
    fp = free_name(docs, "_fp")
    first = (_classes(docs, words).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
             .groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp")))
    keys = [free_name(docs, "_id"), free_name(docs, "_no_id"), fp]
    kept = first.select(F.coalesce("doc_id", F.lit(0)).alias(keys[0]), F.col("doc_id").isNull().alias(keys[1]),
                        F.col("fp").alias(fp))
    place = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in batch.column(place).cast(pa.binary()).to_pylist()]
        values = np.array([simhash(t, words) for t in texts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*batch.schema.names, fp])

    marked = arrow_map(docs, run, schema_with(docs, fp, "bigint")).withColumns({
        keys[0]: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), keys[1]: F.col("doc_id").isNull()})
    return marked.join(kept, keys, "left_semi").dropDuplicates(keys).select(*[F.col(f"`{c}`") for c in docs.columns])
