"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits.

Every word shingle is hashed once. The high bits of the hash choose one of ``BINS`` bins, and
each bin keeps its smallest hash. An empty bin copies the bin that a fixed random sequence of its
own first points to (optimal densification), so two texts copy from the same place wherever both
could. Of every bin the lowest ``BITS`` bits are stored. Two such codes agree by chance once in
``2**BITS``, and the estimate of the Jaccard similarity takes that off.

The edited text of a document needs the next one in order of ``doc_id``. Documents are dealt once
into ranges of ``doc_id``, and the first document of each range goes to the range before it as
well. A task walks through its range in order and holds two texts at a time.

Defined results: NULL text is empty; a text of fewer words than a shingle is one shingle, and a
text without words is the empty shingle, so all such texts are equal; rows with NULL ``doc_id``
come first in order; rows that share a ``doc_id`` follow each other in order of their texts; a
table of one row is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.llm.common import STEP_BYTES, utf8_steps, whole_text

SHINGLE_WORDS = 5
BINS = 128
BITS = 8
SEED = 20_231
#: Rows that share one range of ids; the number of ranges follows the input.
RANGE_ROWS = 1024
#: Ranges at most, which bounds what the driver holds; beyond it ranges get longer and are walked alike.
MOST_RANGES = 65_536


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (multiply, shift, xor), on uint64."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Powers of an odd multiplier; a word's hash is the sum of byte * power over its bytes, mixed.
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_IS_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mix(np.arange(256, dtype=np.uint64) + np.uint64(SEED))


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of several texts, and the text each belongs to.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. Every text has one
    shingle at least.
    """
    n = len(offsets) - 1
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    solid = ~_IS_BLANK[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1] | (text_of[1:] != text_of[:-1])
    at = np.flatnonzero(first)
    if len(at):
        # The position in the word picks the power; from byte 64 on powers come again, and what
        # they give is mixed with the round, so that order still matters.
        start = np.zeros(len(raw), np.int64)
        start[at] = at
        place = np.arange(len(raw)) - np.maximum.accumulate(start)
        value = _VALUE[_LOWER[raw]] * _POWERS[place & 63]
        far = np.flatnonzero(place > 63)
        value[far] = mix(value[far] + (place[far] >> 6).astype(np.uint64))
        value[~solid] = 0
        word = mix(np.add.reduceat(value, at))
    else:
        word = np.zeros(0, np.uint64)
    owner = text_of[at] if len(at) else np.zeros(0, np.int64)
    count = np.bincount(owner, minlength=n)
    begin = np.cumsum(count) - count
    # Shingles that lie within one text, then one for each shorter text.
    long = np.flatnonzero(count >= words)
    sizes = count[long] - words + 1
    total = int(sizes.sum())
    index = np.repeat(begin[long] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
    hashes = np.zeros(total, np.uint64)
    for k in range(words):
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + word[index + k]
    short = np.flatnonzero(count < words)
    rest = np.zeros(len(short), np.uint64)
    for k in range(words - 1):
        has = count[short] > k
        rest[has] = rest[has] * np.uint64(0xD6E8FEB86659FD93) + word[begin[short[has]] + k]
    rest += mix(count[short].astype(np.uint64))
    return mix(np.concatenate([hashes, rest])), np.concatenate([np.repeat(long, sizes), short])


@dataclass(frozen=True)
class OnePermutationMinHash:
    """The fingerprint's parameters: ``bins`` codes of ``bits`` bits over shingles of ``words`` words."""

    words: int = SHINGLE_WORDS
    bins: int = BINS
    bits: int = BITS

    def codes(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row of ``bins`` codes (uint8) for each text."""
        hashes, owner = shingle_hashes(raw, offsets, self.words)
        n = len(offsets) - 1
        low = np.full(n * self.bins, np.iinfo(np.uint64).max, np.uint64)
        bin_of = (hashes >> np.uint64(32)) % np.uint64(self.bins)
        np.minimum.at(low, owner * self.bins + bin_of.astype(np.int64), (hashes << np.uint64(32)) | (hashes >> np.uint64(32)))
        table = low.reshape(n, self.bins)
        return (mix(self.densify(table)) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)

    def codes_of(self, texts: list[str]) -> np.ndarray:
        steps = [self.codes(raw, offsets) for _, _, raw, offsets in utf8_steps(pa.array(texts, pa.large_string()))]
        return np.concatenate(steps)

    def densify(self, table: np.ndarray) -> np.ndarray:
        """Fill empty bins: attempt ``t`` of bin ``i`` looks at bin ``hash(i, t)`` of the same text."""
        empty = table == np.iinfo(np.uint64).max
        out = table.copy()
        row, column = np.nonzero(empty)
        attempt = 1
        while len(row):
            probe = (mix(column.astype(np.uint64) * np.uint64(0x1F123BB5) + np.uint64(attempt << 40))
                     % np.uint64(self.bins)).astype(np.int64)
            hit = ~empty[row, probe]
            out[row[hit], column[hit]] = table[row[hit], probe[hit]]
            row, column = row[~hit], column[~hit]
            attempt += 1
        return out

    def likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Estimated Jaccard similarity of rows of codes, chance agreement taken off, in 0..1."""
        chance = 1.0 / (1 << self.bits)
        return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)


def _neighbours(docs: DataFrame, range_rows: int) -> DataFrame:
    """``(place, ghost, key, doc_id, text)``: documents by ranges of ``doc_id``.

    Each range ends with a ghost: the first document of the range after it, or of the first range
    for the last one. Only ``ranges`` boundaries and heads reach the driver, 16 bytes each.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ids = rows.select(key.alias("key"))
    ranges = min(MOST_RANGES, max(1, -(-ids.count() // range_rows)))
    cuts = np.zeros(0, np.int64)
    if ranges > 1:
        # Where exactly the boundaries lie has no effect on results, so a sketch is enough.
        shares = [i / ranges for i in range(1, ranges)]
        cuts = np.unique(ids.agg(F.percentile_approx("key", shares, max(10_000, 4 * ranges))).first()[0])

    @F.pandas_udf("int")
    def place(keys):
        import pandas as pd
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(), "left").astype(np.int32))

    heads = ids.groupBy(place("key").alias("place")).agg(F.min("key").alias("key")).orderBy("place").collect()
    if not heads:
        heads = [(0, 0)]
    first = np.array([h[1] for h in heads])
    before = np.roll([h[0] for h in heads], 1).astype(np.int32)

    @F.pandas_udf("array<int>")
    def places(keys):
        import pandas as pd
        own = np.searchsorted(cuts, keys.to_numpy(), "left").astype(np.int32)
        at = np.minimum(np.searchsorted(first, keys.to_numpy(), "left"), len(first) - 1)
        return pd.Series([[o, before[i]] if first[i] == k else [o] for o, i, k in zip(own, at, keys)])

    dealt = (rows.withColumn("key", key).withColumn("places", places("key"))
             .select("key", "doc_id", "text", F.posexplode("places").alias("ghost", "place")))
    return dealt.repartition(max(1, ranges // 4), "place").sortWithinPartitions("place", "ghost", "key", "text")


def fingerprint_next(docs: DataFrame, method: OnePermutationMinHash | None = None,
                     range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike neighbours are.

    The edited text is the document with its last ``floor(n_chars / 2)`` code points replaced by
    as many first ones of the next document (all of it if it is shorter). Columns: ``doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    method = method or OnePermutationMinHash()

    def pairs(held: list[tuple]) -> pa.RecordBatch | None:
        use = [i for i in range(len(held) - 1) if not held[i][1] and held[i][0] == held[i + 1][0]]
        if not use:
            return None
        texts = [h[3] for h in held]
        edited = [texts[i][:len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][:len(texts[i]) // 2] for i in use]
        own, changed = method.codes_of(texts), method.codes_of(edited)
        at = np.array(use)
        return pa.RecordBatch.from_arrays([
            pa.array([held[i][2] for i in use], pa.int64()),
            pa.array([len(texts[i]) for i in use], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array([own[i].tobytes().hex() for i in use]), pa.array([c.tobytes().hex() for c in changed]),
            pa.array(method.likeness(own[at], changed)), pa.array(method.likeness(own[at], own[at + 1])),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                held += zip(*(part.column(c).to_pylist() for c in ("place", "ghost", "doc_id", "text")))
                size += part.nbytes
                if size > STEP_BYTES:
                    out = pairs(held)
                    held, size = held[-1:], 0
                    if out is not None:
                        yield out
        if (out := pairs(held)) is not None:
            yield out

    return _neighbours(docs, range_rows).select("place", "ghost", "doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")
