"""Best-fit packing of tokenised documents into fixed-length training sequences.

Method: best-two-fit. A bin is filled greedily with the largest piece that fits. If a gap is
left, its smallest piece is taken out again when two unpacked pieces fill the widened gap more
tightly than that piece did.

Pieces are dealt into shards by a hash of their key, each of about ``SHARD_PIECES`` pieces, and
every shard is packed by one task. A shard holds thousands of lengths, so what it wastes against
a single global packing is about one sequence; tasks stay the same size whatever the input is,
and a source or a group of copies that holds a third of the rows is spread like any other.

Defined results: NULL text is empty (one piece, the end id alone); a NULL ``doc_id`` is kept as
it is; repeated rows are packed as often as they occur; an empty table gives no rows; columns of
the input other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.llm.common import Numbers, sorted_runs, stream_groups, whole_text
from surety.session import materialise

CAPACITY = 4096
END_ID = 1
SHARD_PIECES = 30_000
#: Tasks at most; beyond it a task packs several shards, one after another.
MOST_TASKS = 20_000
#: Chunks of text whose ids a worker remembers; beyond it the memory starts anew.
CACHE_CHUNKS = 1_000_000
MARKS = (b".", b",")


class ChunkEncoder:
    """Ids of whole texts, with the ids of each blank-separated chunk remembered.

    The tokenizer lower-cases, drops white space, and no token spans it, so the ids of a text
    are those of its chunks one after another, with A-Z lower-cased beforehand. Chunks are cut
    at spaces and line feeds only; any other white space is left to the tokenizer. Texts that may
    hold a special token's string go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        # A task has one core; threads of the tokenizer's own would only wait for it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.marks = {m: self.tokenizer.encode(m.decode(), add_special_tokens=False).ids[0] for m in MARKS}
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0

    def learn(self) -> None:
        """Encode the chunks that were numbered since the last call.

        A word with a full stop or comma behind an ASCII letter is the word and the mark: letters
        and marks never share a token.
        """
        new, self.known.new = self.known.new, []
        marked = [c for c in new if c[-1:] in MARKS and c[-2:-1].isalpha()]
        stems = np.fromiter(map(self.known.__getitem__, (c[:-1] for c in marked)), np.int64, len(marked))
        skip = set(marked)
        plain = [c for c in new if c not in skip] + self.known.new
        self.known.new = []
        codes = [c.ids for c in self.tokenizer.encode_batch_fast(
            [c.decode() for c in plain], add_special_tokens=False)]
        size = np.fromiter(map(len, codes), np.int64, len(codes))
        self._store(plain, size, np.fromiter(chain.from_iterable(codes), np.uint32, int(size.sum())))
        size = self.size[stems] + 1
        ends = np.cumsum(size)
        total = int(size.sum())
        at = np.minimum(np.repeat(self.start[stems] - (ends - size), size) + np.arange(total), len(self.flat) - 1)
        ids = self.flat[at]
        ids[ends - 1] = [self.marks[c[-1:]] for c in marked]
        self._store(marked, size, ids)

    def _store(self, chunks: list[bytes], size: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        if len(self.known) > len(self.start):
            room = len(self.known) - len(self.start) + (1 << 16)
            self.start, self.size = (np.concatenate([x, np.zeros(room, np.int64)]) for x in (self.start, self.size))
        number = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        self.start[number], self.size[number] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)

    def batch(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if len(self.known) > CACHE_CHUNKS:
            self.forget()
        plain = [b"" if b"<|" in t else t for t in texts]
        counts = [t.count(b" ") + t.count(b"\n") + 1 for t in plain]
        chunks = b" ".join(plain).lower().replace(b"\n", b" ").split(b" ")
        which = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        if self.known.new:
            self.learn()
        sizes = self.size[which]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.start[which] - (ends - sizes), sizes) + np.arange(ends[-1])]
        borders = ends[np.cumsum(counts) - 1].tolist()
        for text, use, a, b in zip(texts, plain, [0, *borders], borders):
            if use or not text:
                yield ids[a:b]
            else:
                yield np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=1)
def encoder(path: str) -> ChunkEncoder:
    """The encoder of this Python worker; tasks that follow use what earlier ones remember."""
    return ChunkEncoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenise whole texts and cut those longer than ``capacity`` into pieces.

    Columns: ``doc_id, piece, start, length, ids_crc32`` and, with ``keep_ids``, ``ids``.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    if keep_ids:
        schema += ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).batch
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for first in range(0, len(ids), 500):
                rows: list[list] = [[] for _ in range(6 if keep_ids else 5)]
                for doc, code in zip(ids[first:first + 500], encode(texts.slice(first, 500).to_pylist())):
                    code = np.append(code, np.uint32(END_ID)).astype("<u4")
                    for piece, start in enumerate(range(0, len(code), capacity)):
                        part = code[start:start + capacity]
                        values = [doc, piece, start, len(part), zlib.crc32(part.tobytes())]
                        for column, value in zip(rows, [*values, part.astype(np.int32)] if keep_ids else values):
                            column.append(value)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(rows, types)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(rows)])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, schema)


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece; every length is in ``1..capacity``."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")[::-1]
    stock: dict[int, list[int]] = {}
    for i in order.tolist():
        stock.setdefault(int(lengths[i]), []).append(i)
    count = np.zeros(capacity + 1, np.int64)
    for length, items in stock.items():
        count[length] = len(items)
    mask = sum(1 << length for length in stock)

    def take(length: int) -> int:
        nonlocal mask
        item = stock[length].pop()
        count[length] -= 1
        if not count[length]:
            mask ^= 1 << length
        return item

    def give(length: int, item: int) -> None:
        nonlocal mask
        stock.setdefault(length, []).append(item)
        count[length] += 1
        mask |= 1 << length

    number = 0
    while mask:
        held: list[tuple[int, int]] = []
        gap = capacity
        while gap and (fit := (mask & ((1 << (gap + 1)) - 1)).bit_length() - 1) > 0:
            held.append((fit, take(fit)))
            gap -= fit
        if gap and mask and len(held) > 1:
            small = held[-1][0]
            pair = _tighter_pair(count, gap + small, small)
            if pair:
                give(*held.pop())
                held += [(length, take(length)) for length in pair]
        at = 0
        for length, item in held:
            bins[item], offsets[item] = number, at
            at += length
        number += 1
    return bins, offsets


def _tighter_pair(count: np.ndarray, room: int, single: int) -> tuple[int, int] | None:
    """The two lengths in stock with the largest sum in ``single+1 .. room``, if there are any."""
    have = np.flatnonzero(count[:room])
    if not len(have):
        return None
    largest = np.maximum.accumulate(np.where(count[:room + 1] > 0, np.arange(room + 1), 0))
    other = largest[room - have]
    alone = (other == have) & (count[have] < 2)
    other = np.where(alone, largest[np.maximum(have - 1, 0)], other)
    total = np.where(other > 0, have + other, 0)
    best = int(total.argmax())
    return (int(have[best]), int(other[best])) if total[best] > single else None


def pack(parts: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of :func:`pieces`.

    ``sequence_id`` is the shard number times 2**32 plus the bin within the shard. The table is
    materialised first, so that its rows are counted, numbered and dealt from the same files. Only
    keys and lengths are dealt into shards; token ids meet their places in a join by row number.
    """
    parts = materialise(parts)
    shards = max(1, math.ceil(parts.count() / shard_pieces))
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    wide = [c for c in parts.columns if c not in keys]
    rows = parts.withColumn("_row", F.monotonically_increasing_id())
    narrow = rows.drop(*wide)
    names = narrow.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in stream_groups(batches, "_shard"):
            shard = table.column("_shard").to_numpy()
            starts = sorted_runs(shard)
            for a, b in zip(starts[:-1], starts[1:]):
                part = table.slice(a, b - a)
                bins, offsets = best_two_fit(part.column("length").to_numpy(), capacity)
                part = part.select(names).append_column("sequence_id", pa.array(bins + (int(shard[a]) << 32)))
                yield from part.append_column("offset", pa.array(offsets)).to_batches()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields)
    placed = (narrow.withColumn("_shard", F.pmod(F.xxhash64("_row", "doc_id", "piece", "ids_crc32", "length"), F.lit(shards)))
              .repartition(min(shards, MOST_TASKS), "_shard").sortWithinPartitions("_shard", "length", "doc_id", "piece", "ids_crc32")
              .mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint"))
    if not wide:
        return placed.drop("_row")
    return rows.join(placed.select("_row", "sequence_id", "offset"), "_row").drop("_row")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenise and pack ``docs``: one row per piece with its place in a sequence."""
    return pack(pieces(docs, path, capacity, keep_ids), capacity)
