"""One document of each group of near copies: Jaccard similarity of word shingles, verified exactly.

Two texts are linked if the sets of their ``WORDS``-word shingles have a Jaccard similarity of at
least ``LEAST``; groups are the connected components. Fingerprints of 64 bits cannot find such
pairs: at similarity 0.8 they are about ten bits apart, where a grid of bit counts has no cell left
to agree in. Candidates come from MinHash instead: ``BANDS`` bands of ``ROWS`` minima are join
keys, so a pair at exactly 0.8 shares no band with probability ``(1 - 0.8**7)**60``, below one in
a million, and less above. Each text is linked with the smallest of its cell, and the components
of these links are the clusters. Within a cluster ALL pairs are compared by their whole sets; a
cluster of more than ``BLOCK_BYTES`` of sets is cut into blocks of about that size, and each pair of
blocks is a task group of its own. No pair is a row. Memory follows two blocks, or the longest text.

Sets are named by 64-bit hashes, and only distinct sets take part. Defined results: NULL text is
empty; texts of fewer words than a shingle are one shingle, texts without words are equal; a NULL
``doc_id`` stays only where its group has no other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.llm.common import arrow_map, components, free_name, local_roots, schema_with, tidy, utf8_steps, whole_text
from surety.llm.minhash import OnePermutationMinHash, mix, shingle_hashes
from surety.session import materialise

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 60, 7
#: Bytes of sets in one block; two blocks are compared at a time.
BLOCK_BYTES = 2 << 20
#: Places in postings that are counted in one go.
PLACES = 1 << 19


def sets_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(sorted distinct shingle hashes, starts)`` of runs of texts, the length at the end of starts."""
    for first, end, raw, offsets in utf8_steps(texts):
        hashes, owner = shingle_hashes(raw, offsets, WORDS)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
        yield hashes, np.searchsorted(owner, np.arange(end - first + 1))


def names_of(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    return mix(np.add.reduceat(mix(hashes + np.uint64(1)), starts[:-1]) + np.diff(starts).astype(np.uint64)).view(np.int64)


def bands_of(hashes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Join keys of each set; sets below four shingles have none, as 0.8 needs equal sets there."""
    sizes = np.diff(starts)
    large = np.flatnonzero(sizes >= 4)
    out = [np.zeros(0, np.int64)] * len(sizes)
    method = OnePermutationMinHash(WORDS, BANDS * ROWS)
    for a in range(0, len(large), 256):
        some = large[a:a + 256]
        use = np.isin(np.repeat(np.arange(len(sizes)), sizes), some)
        h, owner = hashes[use], np.repeat(np.arange(len(some)), sizes[some])
        low = np.full(len(some) * method.bins, np.iinfo(np.uint64).max, np.uint64)
        place = ((h >> np.uint64(32)) % np.uint64(method.bins)).astype(np.int64)
        np.minimum.at(low, owner * method.bins + place, (h << np.uint64(32)) | (h >> np.uint64(32)))
        table = mix(method.densify(low.reshape(len(some), method.bins))).reshape(len(some), BANDS, ROWS)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), table.shape[:2])
        for r in range(ROWS):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + table[:, :, r])
        for i, k in zip(some.tolist(), key.view(np.int64)):
            out[i] = k
    return out


def _marks(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, bands)``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, bands = [], []
        for hashes, starts in sets_of(batch.column(1)):
            names.append(names_of(hashes, starts))
            bands += bands_of(hashes, starts)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(names)), pa.array(bands, pa.list_(pa.int64()))],
                                          names=["doc_id", "fp", "bands"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")), run,
                     "doc_id bigint, fp bigint, bands array<bigint>")


def _named(docs: DataFrame, out: str) -> DataFrame:
    """``docs`` with the name of each text's set in the column ``out``."""
    place = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = np.concatenate([names_of(*s) for s in sets_of(batch.column(place).fill_null(""))])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(names)], names=[*batch.schema.names, out])

    return arrow_map(docs, run, schema_with(docs, out, "bigint"))


def alike(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets with a Jaccard similarity of at least ``LEAST``."""
    n = len(starts) - 1
    sizes = np.diff(starts)
    order = np.argsort(hashes, kind="stable")
    new = np.append(True, hashes[order[1:]] != hashes[order[:-1]]) if len(hashes) else np.zeros(0, bool)
    # Sets that hold each word, word by word, and for each place in a set where its word's sets begin and end.
    posted = np.repeat(np.arange(n, dtype=np.int32), sizes)[order]
    first = np.flatnonzero(np.append(new, True)).astype(np.int32)
    word = np.empty(len(hashes), np.int32)
    word[order] = np.cumsum(new) - 1
    none = np.zeros(0, np.int64)
    left, right = [], []
    for i in range(n):
        mine = word[starts[i]:starts[i + 1]]
        counts = (first[mine + 1] - first[mine]).astype(np.int64)
        ends = np.cumsum(counts)
        both = np.zeros(n, np.int64)
        a = 0
        while a < len(mine):
            before = ends[a] - counts[a]
            b = max(int(np.searchsorted(ends, before + PLACES, "right")), a + 1)
            at = np.repeat(first[mine[a:b]] - (ends[a:b] - counts[a:b] - before), counts[a:b]) + np.arange(ends[b - 1] - before)
            both += np.bincount(posted[at], minlength=n)
            a = b
        # both / (all - both) >= 0.8 in whole numbers
        near = np.flatnonzero(9 * both >= 4 * (sizes + sizes[i]))
        near = near[near > i]
        left.append(np.full(len(near), i))
        right.append(near)
    return np.concatenate([*left, none]), np.concatenate([*right, none])


def _linked(fp: list[int], sets: list[bytes]) -> pa.RecordBatch | None:
    """Links of the sets of one cell to the smallest index they reach in it."""
    starts = np.cumsum([0, *(len(s) // 8 for s in sets)])
    roots = local_roots(len(sets), *alike(np.frombuffer(b"".join(sets), np.uint64), starts))
    names = np.array(fp, np.int64)
    linked = np.flatnonzero(roots != np.arange(len(sets)))
    if len(linked):
        return pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(names[roots[linked]])], names=["a", "b"])
    return None


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each cell of a stream sorted by cell; only the cell at hand is held."""
    cell, fp, sets = None, [], []
    for batch in batches:
        for c, f, s in zip(*(batch.column(x) for x in ("cell", "fp", "shingles"))):
            if c.as_py() != cell:
                found = _linked(fp, sets)
                if found is not None:
                    yield found
                cell, fp, sets = c.as_py(), [], []
            fp.append(f.as_py())
            sets.append(s.as_py())
    found = _linked(fp, sets)
    if found is not None:
        yield found


def _keys(docs: DataFrame, names: list[str]) -> dict:
    return {names[0]: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), names[1]: F.col("doc_id").isNull()}


def keep_one(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One document of each group of near copies, with the columns of ``docs``.

    The smallest ``doc_id`` of the group stays, and one of rows that repeat it with an equal set.
    """
    rows = materialise(_marks(docs))
    lowest = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    cells = rows.select("fp", F.explode("bands").alias("cell"))
    lead = cells.groupBy("cell").agg(F.min("fp").alias("lead"), F.max("fp").alias("last")).where("lead < last").select("cell", "lead")
    near = cells.join(lead, "cell").where("fp <> lead").select(F.col("fp").alias("a"), F.col("lead").alias("b"))
    clusters = materialise(components(near).withColumnRenamed("node", "fp"))
    del rows, cells, lead, near         # the bands are read no more
    tidy(docs.sparkSession)

    # Whole sets of one document for each distinct set of the clusters.
    keys = [free_name(docs, "_id"), free_name(docs, "_no_id")]
    wanted = (lowest.join(clusters, "fp")
              .select("fp", "root", F.coalesce("low", F.lit(0)).alias("_id"), F.col("low").isNull().alias("_no_id")))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    texts = _named(texts, "fp").select("fp", "text", *[v.alias(k) for k, v in _keys(texts, ["_id", "_no_id"]).items()])
    chosen = texts.join(wanted, ["fp", "_id", "_no_id"]).select("fp", "root", "text")

    def shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [h[a:b].tobytes() for h, s in sets_of(batch.column(2)) for a, b in zip(s[:-1], s[1:])]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], names=["fp", "root", "shingles"])

    # Rows that repeat an id have one set; the first of them is kept.
    whole = materialise(arrow_map(chosen, shingles, "fp bigint, root bigint, shingles binary")
                        .groupBy("fp", "root").agg(F.any_value("shingles").alias("shingles")))
    del clusters, wanted, texts, chosen
    tidy(docs.sparkSession)
    sizes = materialise(whole.groupBy("root").agg(F.sum(F.octet_length("shingles").cast("bigint")).alias("bytes")))
    blocks = F.ceil(F.col("bytes") / block_bytes).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.xxhash64(
        F.col("root"), F.least(mine, other), F.greatest(mine, other)))
    links = (whole.join(sizes, "root").select("fp", "shingles", F.explode(meets).alias("cell")).repartition("cell")
             .sortWithinPartitions("cell", "fp").mapInArrow(_verified, "a bigint, b bigint"))

    grouped = components(links).withColumnRenamed("node", "fp")
    del whole, sizes, links             # so are the sets
    tidy(docs.sparkSession)
    class_of = lowest.join(grouped, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    # The smallest id, NULL last; of sets that share it the smaller name.
    first = class_of.groupBy("root").agg(F.min(F.struct(F.col("low").isNull(), "low", "fp")).alias("best"))
    fp = free_name(docs, "_fp")
    kept = first.select(F.coalesce("best.low", F.lit(0)).alias(keys[0]), F.col("best.low").isNull().alias(keys[1]),
                        F.col("best.fp").alias(fp))
    marked = _named(docs, fp).withColumns(_keys(docs, keys))
    return marked.join(kept, [*keys, fp], "left_semi").dropDuplicates([*keys, fp]).select(*[F.col(f"`{c}`") for c in docs.columns])
