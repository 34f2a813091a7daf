"""Removal of repeated byte strings by a distributed difference-cover suffix sort.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else is removed.

Sorting all byte suffixes of a corpus would move hundreds of bytes for each byte of text, so the
text is first made short without losing a repeat:

1. *Regions.* A window of ``LENGTH`` bytes always holds the smallest hash of its 100-byte strings,
   wherever it stands. Only text around such a chosen string that occurs twice can hold a repeat.
2. *Phrases.* Regions are cut at the smallest hash of every 50 neighbouring 20-byte strings. Equal
   windows are cut alike, and what stands between two cuts is a phrase (25 bytes on average, 50 at
   most). At each cut the string to be sorted has one character, the phrases from there on that
   hold ``CHARACTER`` bytes. A window's *first cut* is the smallest hash in its first
   50 positions; from there on equal windows share at least ``CORE`` bytes of whole phrases.
3. *Difference cover.* The suffixes at positions 1 and 2 modulo 3 are sorted by triples of
   characters, the triples are named by their order, and where a triple is shorter than the core,
   the names are sorted recursively (names that reach far enough are discarded from the recursion).
   The suffixes at 0 modulo 3 are then merged in: compared with class 1 by (character, rank of the
   next), with class 2 by (character, character, rank of the one after).
4. *Adjacent prefixes.* Suffixes with the same core stand side by side. Each such class holds all
   windows that can be equal; the bytes that all windows of a cut share divide it further. A cut
   whose whole surroundings occur twice settles all its windows at once; the windows of the others
   are compared one by one inside their part of the class.

All sorts are range-partitioned with ties split by position, so a passage that a third of the
documents share is spread over many tasks. Equal texts are sorted once. Strings are compared by
64-bit hashes (two of them together in step 4).

Defined results: NULL text is empty; texts shorter than ``LENGTH`` lose nothing; repeated rows
count as different places, so all copies of a long enough text lose everything; a NULL ``doc_id``
is kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.llm.common import (STEP_BYTES, Scratch, arrow_map, free_name, slices, sorted_runs, stream_groups, utf8_steps,
                               whole_text)
from surety.llm.minhash import mix
from surety.session import materialise

LENGTH = 200
#: Region seeds: strings of SEED bytes, the smallest of LENGTH - SEED + 1 neighbours.
SEED = 100
#: Phrase cuts: strings of GRAM bytes, the smallest of SPREAD neighbours.
GRAM, SPREAD = 20, 50
#: Bytes of whole phrases that equal windows share from their first cut on, at least.
CORE = LENGTH - GRAM - 2 * SPREAD - SPREAD + 3
#: Bytes from a cut on that all of its windows hold.
RIGHT = LENGTH - SPREAD + 1
#: Bytes of whole phrases that one character of the sorted string holds, at least.
CHARACTER = 24

_STEP = 0x9E3779B97F4A7C15
_VALUE = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))


class Rolling:
    """64-bit hashes of any substrings of one byte string, from running sums."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw)
        if len(Rolling._powers) < n + 1:
            size = max(n + 1, 2 * STEP_BYTES)
            Rolling._powers = np.cumprod(np.full(size, _STEP, np.uint64), dtype=np.uint64)
            Rolling._inverse = np.cumprod(np.full(size, pow(_STEP, -1, 1 << 64), np.uint64), dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[raw] * Rolling._powers[:n], dtype=np.uint64, out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        """Hash of the ``length`` bytes from each position on."""
        n = max(len(self.sums) - length, 0)
        return mix((self.sums[length:length + n] - self.sums[:n]) * Rolling._inverse[:n])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Rolling._inverse[start]
                   + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest of each ``width`` neighbours (upper halves are compared)."""
    m = (values & ~np.uint64(0xFFFFFFFF)) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[:len(m) - (width - span)], m[width - span:])
    return (m & np.uint64(0xFFFFFFFF)).astype(np.int64)


def chosen(rolling: Rolling, offsets: np.ndarray, gram: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window start that fits its text: ``(start, chosen position, text)``."""
    sizes = np.diff(offsets)
    hashes = rolling.windows(gram)
    if len(hashes) < width:
        return (np.zeros(0, np.int64),) * 3
    pick = smallest(hashes, width)
    room = np.maximum(sizes - (gram + width - 2), 0)
    total = int(room.sum())
    text = np.repeat(np.arange(len(sizes)), room)
    start = np.arange(total) - np.repeat(np.cumsum(room) - room, room) + np.repeat(offsets[:-1], room)
    return start, pick[start], text


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


# --- regions -----------------------------------------------------------------------------------

def _seeds(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Seeds of the distinct texts of a batch, columns ``key, tid, pos, kind``.

    Kind 0 asks whether the seed ``key`` occurs elsewhere; of each seed a batch asks once. Kind 1
    tells that it does. Kind 2 is a place already known to be repeated; its key only spreads rows.
    """
    tids = batch.column(0).to_numpy()
    _, first = np.unique(tids, return_index=True)
    batch = batch.take(pa.array(np.sort(first)))
    tids = batch.column(0).to_numpy()
    keys, places, owners = [], [], []
    for begin, _, raw, offsets in utf8_steps(batch.column(1)):
        rolling = Rolling(raw)
        _, pick, text = chosen(rolling, offsets, SEED, LENGTH - SEED + 1)
        new = np.ones(len(pick), bool)
        new[1:] = (pick[1:] != pick[:-1]) | (text[1:] != text[:-1])
        pick, text = pick[new], text[new]
        keys.append(rolling.between(pick, pick + SEED))
        places.append(pick - offsets[text])
        owners.append(tids[begin + text])
    key, place, owner = (np.concatenate(x) for x in (keys, places, owners))
    order = np.argsort(key, kind="stable")
    key, place, owner = key[order], place[order], owner[order]
    starts = sorted_runs(key)
    size = np.diff(starts)
    repeated = np.repeat(size > 1, size)
    ask = starts[:-1] if len(key) else np.zeros(0, np.int64)
    kind = np.concatenate([(size > 1).astype(np.int8) if len(key) else np.zeros(0, np.int8),
                           np.full(int(repeated.sum()), 2, np.int8)])
    spread = mix(owner[repeated].view(np.uint64) + place[repeated].astype(np.uint64))
    return pa.RecordBatch.from_arrays([
        _signed(np.concatenate([key[ask], spread])), pa.array(np.concatenate([owner[ask], owner[repeated]])),
        pa.array(np.concatenate([place[ask], place[repeated]]).astype(np.int32)), pa.array(kind)],
        names=["key", "tid", "pos", "kind"])


def _repeated_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of seeds that occur twice, from rows sorted by ``key``; holds one row between batches."""
    held = None         # (key, tid, pos) of an asker without a partner so far
    met = None          # latest key known to occur twice
    for batch in batches:
        if not batch.num_rows:
            continue
        key, tid, pos, kind = (batch.column(c).to_numpy() for c in ("key", "tid", "pos", "kind"))
        asks = np.flatnonzero(kind < 2)
        out_tid, out_pos = [tid[kind == 2]], [pos[kind == 2]]
        k, t, p, tells = key[asks], tid[asks], pos[asks], kind[asks] == 1
        if len(k):
            starts = sorted_runs(k)
            size = np.diff(starts)
            differ = np.zeros(len(k), bool)
            differ[1:] = (k[1:] == k[:-1]) & ((t[1:] != t[:-1]) | (p[1:] != p[:-1]))
            yes = np.logical_or.reduceat(differ | tells, starts[:-1])
            if held is not None and held[0] == k[0]:
                if held[1:] != (int(t[0]), int(p[0])) or yes[0]:
                    yes[0] = True
                    out_tid.append(np.array([held[1]]))
                    out_pos.append(np.array([held[2]], np.int32))
            if met is not None and met == k[0]:
                yes[0] = True
            good = np.repeat(yes, size)
            out_tid.append(t[good])
            out_pos.append(p[good])
            met = int(k[-1]) if yes[-1] else met
            held = None if yes[-1] else (int(k[-1]), int(t[-1]), int(p[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_tid)), pa.array(np.concatenate(out_pos).astype(np.int32))],
                                         names=["tid", "pos"])


def _cut_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions ``(tid, start, data)`` from rows ``(tid, text, places)``; a text that comes again is left out."""
    seen: set[int] = set()
    for batch in (part for whole in batches for part in slices(whole)):
        tids, starts, data = [], [], []
        texts = batch.column(1).cast(pa.binary())
        for row, tid in enumerate(batch.column(0).to_pylist()):
            if tid in seen:
                continue
            seen.add(tid)
            text = texts[row].as_py()
            place = np.sort(batch.column(2)[row].values.to_numpy().astype(np.int64))
            begin = np.maximum(place - (LENGTH - SEED), 0)
            end = np.minimum(place + LENGTH, len(text))
            opens = np.ones(len(place), bool)
            opens[1:] = begin[1:] > end[:-1]
            first = np.flatnonzero(opens)
            for a, b in zip(begin[first].tolist(), end[np.append(first[1:], len(place)) - 1].tolist()):
                tids.append(tid)
                starts.append(a)
                data.append(text[a:b])
        yield pa.RecordBatch.from_arrays([pa.array(tids, pa.int64()), pa.array(starts, pa.int32()), pa.array(data, pa.binary())],
                                         names=["tid", "start", "data"])


def _first_of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    _, first = np.unique(batch.column(0).to_numpy(), return_index=True)
    return batch.take(pa.array(np.sort(first)))


def regions(scratch: Scratch, texts: DataFrame) -> DataFrame:
    """``(seg, tid, start, data)``: the stretches of the distinct texts that can hold a repeat.

    ``texts`` has ``tid`` (a hash of the text) and ``text``. Copies are thinned out before anything
    is shuffled.
    """
    long = texts.where(F.octet_length("text") >= LENGTH)
    places = (arrow_map(long, _seeds, "key bigint, tid bigint, pos int, kind tinyint")
              .repartition("key").sortWithinPartitions("key").mapInArrow(_repeated_seeds, "tid bigint, pos int")
              .groupBy("tid").agg(F.collect_set("pos").alias("places")))
    once = arrow_map(long.select("tid", "text"), _first_of_batch, "tid bigint, text string")
    cut = (once.join(places, "tid").select("tid", "text", "places")
           .mapInArrow(_cut_regions, "tid bigint, start int, data binary"))
    # A hot text may be split over tasks by adaptive execution; each region stays once.
    return scratch.keep(cut.withColumn("seg", F.xxhash64("tid", "start")).dropDuplicates(["seg"]))


# --- phrases -----------------------------------------------------------------------------------

class Parse:
    """Cuts of several regions: where they are, which windows start at them, and their phrases."""

    def __init__(self, data: list[bytes]) -> None:
        self.offsets = np.cumsum([0, *map(len, data)])
        self.rolling = Rolling(np.frombuffer(b"".join(data), np.uint8))
        start, pick, text = chosen(self.rolling, self.offsets, GRAM, SPREAD)
        opens = np.ones(len(pick), bool)
        opens[1:] = (pick[1:] != pick[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(opens)
        self.cut, self.text = pick[at], text[at]
        self.first = start[at]                                  # first window of the cut
        last = start[np.append(at[1:], len(pick)) - 1] if len(at) else at
        self.windows = np.maximum(np.minimum(last, self.offsets[self.text + 1] - LENGTH) - self.first + 1, 0)
        count = np.bincount(self.text, minlength=len(data))
        begin = np.cumsum(count) - count
        self.number = np.arange(len(self.cut)) - begin[self.text]
        self.stop = (begin + count)[self.text]                  # end of the region's cuts

    def _reach(self, size: int) -> np.ndarray:
        """For each cut, the number of the first cut ``size`` bytes on or more, or its region's end."""
        return np.minimum(np.searchsorted(self.cut, self.cut + size), self.stop)

    def core(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each cut's core, 0 where the region ends before, and the characters that hold it.

        Where the region ends before, the characters up to the end count. So how many are needed is
        the same for all suffixes that begin with these characters.
        """
        end = self._reach(CORE)
        has = end < self.stop
        key = np.zeros(len(self.cut), np.uint64)
        key[has] = self.rolling.between(self.cut[has], self.cut[end[has]]) | np.uint64(1)
        return key, np.searchsorted(self._reach(CHARACTER), end) - np.arange(len(self.cut)) + 1

    def characters(self) -> np.ndarray:
        """A positive number for each character; two rows more for those that follow, 0 past the end.

        A character is the phrases from a cut on that hold ``CHARACTER`` bytes, or the rest of the
        region and its end.
        """
        n = len(self.cut)
        end = self._reach(CHARACTER)
        ended = end == self.stop
        after = np.where(ended, self.offsets[self.text + 1], self.cut[np.minimum(end, n - 1)]) if n else end
        c = self.rolling.between(self.cut, after) + ended * np.uint64(0xD1B54A32D192ED03)
        c = ((c >> np.uint64(1)) | np.uint64(1)).astype(np.int64)
        out = np.zeros((3, n), np.int64)
        for k in range(3):
            has = np.arange(n) + k < self.stop
            out[k, has] = c[np.flatnonzero(has) + k]
        return out


def _in_steps(batch: pa.RecordBatch, budget: int = STEP_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    data = batch.column("data").to_pylist()
    first, size = 0, 0
    for i, d in enumerate(data):
        if size + len(d) > budget and i > first:
            yield first, i, data[first:i]
            first, size = i, 0
        size += len(d)
    if first < len(data):
        yield first, len(data), data[first:]


def _phrases(batch: pa.RecordBatch) -> pa.RecordBatch:
    segs = batch.column("seg").to_numpy()
    columns: list[list] = [[] for _ in range(7)]
    for first, end, data in _in_steps(batch):
        p = Parse(data)
        core, need = p.core()
        values = (segs[first:end][p.text], p.number, *p.characters(), core.view(np.int64), need)
        for column, value in zip(columns, values):
            column.append(value)
    arrays = [np.concatenate(c) for c in columns]
    kinds = [np.int64, np.int32, np.int64, np.int64, np.int64, np.int64, np.int32]
    return pa.RecordBatch.from_arrays([pa.array(a.astype(k)) for a, k in zip(arrays, kinds)],
                                      names=["seg", "i", "c", "c1", "c2", "core", "need"])


# --- difference cover --------------------------------------------------------------------------

def ordered(scratch: Scratch, df: DataFrame, keys: Sequence[str], run: Sequence[str] = (), flag: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Sort globally; returns the stored rows and a view of them that adds ``pos``, the place in the order.

    With ``run``: also ``name``, the place of the first row of the same values in these columns,
    and ``lone``, whether no neighbour has them. With ``flag``: also ``zeros``, the number of
    earlier rows whose flag is 0. Rows are range-partitioned by ``keys``, numbered inside each
    partition as they pass, and stored; one summary row for each partition is added up in the
    driver.
    """
    names = df.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, at, zeros, run_start, last = TaskContext.get().partitionId(), 0, 0, 0, None
        held: pa.RecordBatch | None = None      # the latest row, while it is alone in its run
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            place = np.arange(at, at + n)
            opens = np.zeros(n, bool)
            values = [batch.column(c).to_numpy() for c in run]
            for v in values:
                opens[1:] |= v[1:] != v[:-1]
            opens[0] = tuple(int(v[0]) for v in values) != last
            start = np.maximum.accumulate(np.where(opens, place, run_start))
            before = np.zeros(n, np.int64)
            if flag:
                is_zero = (batch.column(flag).to_numpy() == 0).astype(np.int64)
                before = zeros + np.cumsum(is_zero) - is_zero
                zeros += int(is_zero.sum())
            lone = opens & np.append(opens[1:], True)
            last, run_start, at = tuple(int(v[-1]) for v in values), int(start[-1]), at + n
            out = pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, pid, np.int32)), pa.array(place), pa.array(start), pa.array(before), pa.array(lone)],
                names=[*names, "_pid", "_at", "_run", "_zeros", "_lone"])
            if held is not None:
                yield held if opens[0] else held.set_column(len(names) + 4, "_lone", pa.array([False]))
                held = None
            if run and lone[-1]:
                held = out.slice(n - 1)
                out = out.slice(0, n - 1)
            yield out
        if held is not None:
            yield held

    added = T._parse_datatype_string("_pid int, _at bigint, _run bigint, _zeros bigint, _lone boolean")
    rows = scratch.keep(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                        .mapInArrow(number, T.StructType([*df.schema.fields, *added.fields])))
    ends = F.struct(*run) if run else F.lit(0)
    zero = F.sum((F.col(flag) == 0).cast("bigint")) if flag else F.lit(0)
    parts = rows.groupBy("_pid").agg(
        F.count("*").alias("n"), zero.alias("z"), F.min_by(ends, "_at").alias("head"),
        F.max_by(ends, "_at").alias("tail"), F.max("_run").alias("tail_run")).orderBy("_pid").collect()
    table: list[list] = []
    before = zeros = tail_name = 0
    for k, p in enumerate(parts):
        goes_on = bool(run) and k > 0 and p["head"] == parts[k - 1]["tail"]
        head_name = tail_name if goes_on else before
        if goes_on:
            table[-1][5] = True
        table.append([p["_pid"], before, zeros, head_name, goes_on, False, p["n"] - 1])
        tail_name = before + p["tail_run"] if p["tail_run"] else head_name
        before, zeros = before + p["n"], zeros + p["z"]
    # One row for each partition: a bound that does not follow the rows.
    offsets = df.sparkSession.createDataFrame(
        table, "_pid int, _before bigint, _z bigint, _head bigint, _joins boolean, _goes boolean, _end bigint")
    view = rows.join(F.broadcast(offsets), "_pid").withColumn("pos", F.col("_before") + F.col("_at"))
    more = ["pos"]
    if run:
        met = (F.col("_joins") & (F.col("_run") == 0)) | (F.col("_goes") & (F.col("_at") == F.col("_end")))
        view = view.withColumn("name", F.when(F.col("_run") == 0, F.col("_head")).otherwise(F.col("_before") + F.col("_run")))
        view = view.withColumn("lone", F.col("_lone") & ~met)
        more += ["name", "lone"]
    if flag:
        view = view.withColumn("zeros", F.col("_z") + F.col("_zeros"))
        more.append("zeros")
    return rows, view.select(*names, *more)


def _following(column: str, step: int, by: Window) -> Column:
    """The value ``step`` positions on in the same string, 0 where there is no such position."""
    there = F.lead("i", step).over(by) == F.col("i") + step
    return F.coalesce(F.when(there, F.lead(column, step).over(by)), F.lit(0).cast("bigint"))


def suffix_order(scratch: Scratch, rows: DataFrame, reach: int = 1) -> DataFrame:
    """Sort keys ``k1, k2, k3`` of all suffixes of the strings ``rows``; ``seg, i, core`` are kept.

    ``rows`` has ``seg, i, c, c1, c2, need, core``: characters at consecutive ``i`` of string
    ``seg``, the two that follow, how many characters of the original string have to decide the
    suffix's order (one here stands for ``reach`` of them), and a number that is carried along.
    Suffixes equal in all those characters may come in any order.
    """
    by = Window.partitionBy("seg").orderBy("i")
    stored, named = ordered(scratch, rows.where("i % 3 <> 0"), ["c", "c1", "c2", "seg", "i"], ["c", "c1", "c2"])
    named = named.withColumn("open", F.col("need") > 3 * reach)
    better = _recurse(scratch, named, 3 * reach) if named.where("open").limit(1).count() else None
    ranks = named.select("seg", "i", "c", "c1", "core", "pos")
    if better is not None:
        ranks = ranks.join(better, ["seg", "i"], "left").withColumn("pos", F.coalesce("better", "pos")).drop("better")
    # Characters and ranks of one string meet here: one shuffle by string.
    both = ranks.select("seg", "i", "c", "c1", "core", (F.col("pos") + 1).alias("rank")).unionByName(
        rows.where("i % 3 = 0").select("seg", "i", "c", "c1", "core", F.lit(None).cast("bigint").alias("rank")))
    rich = scratch.keep(both.select("*", _following("rank", 1, by).alias("r1"), _following("rank", 2, by).alias("r2"),
                                    (F.col("i") % 3).cast("int").alias("kind")))
    scratch.drop(stored, *([better] if better is not None else []))
    stored_1, first = ordered(scratch, rich.where("kind < 2").select("c", "r1", "kind", "seg", "i", "core"),
                              ["c", "r1", "kind", "seg", "i"], flag="kind")
    stored_2, second = ordered(scratch, rich.where("kind <> 1").select("c", "c1", "r2", "kind", "seg", "i"),
                               ["c", "c1", "r2", "kind", "seg", "i"], flag="kind")
    # Samples that come before a suffix of class 0 are counted in both merges and added up.
    earlier = (F.col("pos") - F.col("zeros")).alias("n")
    none = F.lit(None).cast("bigint")
    zero = (first.where("kind = 0").select("seg", "i", earlier, F.col("zeros").alias("z"), "core")
            .unionByName(second.where("kind = 0").select("seg", "i", earlier, none.alias("z"), none.alias("core")))
            .groupBy("seg", "i").agg(F.sum("n").alias("k1"), F.max("z").alias("k3"), F.max("core").alias("core")))
    out = scratch.keep(
        zero.select("seg", "i", "k1", F.lit(0).alias("k2"), "k3", "core").unionByName(
            rich.where("kind > 0").select("seg", "i", (F.col("rank") - 1).alias("k1"), F.lit(1).alias("k2"),
                                          F.lit(0).cast("bigint").alias("k3"), "core")))
    scratch.drop(rich, stored_1, stored_2)
    return out


def _recurse(scratch: Scratch, named: DataFrame, reach: int) -> DataFrame:
    """``(seg, i, better)``: places of samples that share a name too short, by the names after it."""
    step = Window.partitionBy("seg", F.col("i") % 3).orderBy("i")
    led = F.lag("open").over(step) & (F.lag("i", 1).over(step) == F.col("i") - 3)
    used = named.select("seg", "i", "name", "open", "need").withColumn("led", F.coalesce(led, F.lit(False))).where("open or led")
    inner = scratch.keep(used.select(
        F.xxhash64("seg", F.col("i") % 3).alias("inner_seg"), F.floor(F.col("i") / 3).cast("int").alias("inner_i"),
        "seg", "i", "name", "open", "need"))
    by = Window.partitionBy("seg").orderBy("i")
    string = inner.select(F.col("inner_seg").alias("seg"), F.col("inner_i").alias("i"), (F.col("name") + 1).alias("c"),
                          F.when(F.col("open"), F.col("need")).otherwise(0).alias("need"), F.col("name").alias("core"))
    string = scratch.keep(string.withColumns({"c1": _following("c", 1, by), "c2": _following("c", 2, by)}))
    order = suffix_order(scratch, string, reach)
    # Suffixes of one name stand together here; their places in the run become places in the name.
    stored, inside = ordered(scratch, order, ["k1", "k2", "k3", "seg", "i"], ["core"])
    inside = inside.select(F.col("seg").alias("inner_seg"), F.col("i").alias("inner_i"),
                           (F.col("core") + F.col("pos") - F.col("name")).alias("better"))
    out = scratch.keep(inner.where("open").select("inner_seg", "inner_i", "seg", "i").join(inside, ["inner_seg", "inner_i"])
                       .select("seg", "i", "better"))
    scratch.drop(inner, string, order, stored)
    return out


# --- repeats -----------------------------------------------------------------------------------

def classes(scratch: Scratch, parts: DataFrame) -> DataFrame:
    """``(seg, i, class)`` of all cuts that stand next to one with the same core in suffix order."""
    phrases = scratch.keep(arrow_map(parts.select("seg", "data"), _phrases,
                                     "seg bigint, i int, c bigint, c1 bigint, c2 bigint, core bigint, need int"))
    order = suffix_order(scratch, phrases)
    scratch.drop(phrases)
    stored, placed = ordered(scratch, order, ["k1", "k2", "k3", "seg", "i"], ["core"])
    scratch.drop(order)
    found = scratch.keep(placed.where("core <> 0 and not lone").select("seg", "i", F.col("name").alias("class")))
    scratch.drop(stored)
    return found


#: What is asked about a string: whether it occurs elsewhere; that it does; nothing any more.
ASK, TELL, PASS = 0, 1, 2


def _asked_once(key: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-aggregation of one batch: ``(rows, keys to deal them by, kind)``.

    Of each key one row goes to where all rows of the key meet. Where the batch itself has the key
    twice, or knows it, that row tells so and the others need no answer.
    """
    order = np.argsort(key, kind="stable")
    starts = sorted_runs(key[order])
    if not len(key):
        return order, key, np.zeros(0, np.int8)
    size = np.diff(starts)
    sure = (size > 1) | np.logical_or.reduceat(known[order], starts[:-1])
    kind = np.full(len(key), PASS, np.int8)
    kind[starts[:-1]] = np.where(sure, TELL, ASK)
    deal = key[order].copy()
    passing = np.flatnonzero(kind == PASS)
    deal[passing] = mix(deal[passing] + passing.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    return order, deal, kind


def _answers(table: pa.Table) -> np.ndarray:
    """For whole groups of rows by ``key``: 0 alone, 1 the first of several, 2 another of several."""
    key, kind = table.column("key").to_numpy(), table.column("kind").to_numpy()
    answer = np.full(len(key), 2, np.int8)
    at = np.flatnonzero(kind != PASS)
    if len(at):
        starts = sorted_runs(key[at])
        several = (np.diff(starts) > 1) | np.logical_or.reduceat(kind[at] == TELL, starts[:-1])
        answer[at[starts[:-1]]] = several
    return answer


def _listed(batch: pa.RecordBatch, first: int, end: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The cuts listed for some regions: the region of each, and its fields."""
    lists = batch.column("cuts").slice(first, end - first)
    flat = lists.flatten()
    owner = np.repeat(np.arange(end - first), np.diff(lists.offsets.to_numpy()))
    return owner, {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def _around(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``(key, kind, class, windows, tid, lo, seg)`` for the listed cuts of each region that start windows."""
    out: list[list] = [[] for _ in range(6)]
    tids, starts, segs = (batch.column(c).to_numpy() for c in ("tid", "start", "seg"))
    for first, end, data in _in_steps(batch):
        p = Parse(data)
        owner, cuts = _listed(batch, first, end)
        at = np.searchsorted(p.text, np.arange(len(data)))[owner] + cuts["i"]
        used = p.windows[at] > 0
        owner, at, group = owner[used], at[used], cuts["class"][used]
        lo, n = p.first[at], p.windows[at]
        # All windows of a cut hold the RIGHT bytes behind it: they divide the class further.
        cut = p.cut[at]
        group = p.rolling.between(cut, cut + RIGHT) + mix(group.astype(np.uint64))
        surround = p.rolling.between(lo, lo + n - 1 + LENGTH) + mix(group)
        for column, value in zip(out, (surround, group.view(np.int64), n, tids[first:end][owner],
                                       starts[first:end][owner] + lo - p.offsets[owner], segs[first:end][owner])):
            column.append(value)
    key, *rest = (np.concatenate(c) for c in out)
    order, deal, kind = _asked_once(key.astype(np.uint64), np.zeros(len(key), bool))
    kinds = [np.int64, np.int32, np.int64, np.int32, np.int64]
    return pa.RecordBatch.from_arrays([_signed(deal), pa.array(kind), *(pa.array(a[order].astype(k)) for a, k in zip(rest, kinds))],
                                      names=["key", "kind", "class", "windows", "tid", "lo", "seg"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`_around` with the answer to each as ``state``."""
    for table in stream_groups(batches, "key"):
        answer = pa.array(_answers(table))
        yield from table.select(["class", "windows", "tid", "lo", "seg"]).append_column("state", answer).combine_chunks().to_batches()


def _single_windows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``(key, kind, tid, at)``: every window of the listed cuts; those already known only tell."""
    out: list[list] = [[] for _ in range(4)]
    tids, starts = batch.column("tid").to_numpy(), batch.column("start").to_numpy()
    for first, end, data in _in_steps(batch):
        offsets = np.cumsum([0, *map(len, data)])
        rolling = Rolling(np.frombuffer(b"".join(data), np.uint8))
        owner, cuts = _listed(batch, first, end)
        n = cuts["windows"].astype(np.int64)
        shift = offsets[owner] - starts[first:end][owner]
        at = np.repeat(cuts["lo"] + shift - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        group = mix(cuts["class"].astype(np.uint64))
        for column, value in zip(out, (rolling.between(at, at + LENGTH) + np.repeat(group, n), np.repeat(tids[first:end][owner], n),
                                       (at - np.repeat(shift, n)).astype(np.int32), np.repeat(cuts["known"].astype(bool), n))):
            column.append(value)
    key, tid, at, known = (np.concatenate(c) for c in out)
    order, deal, kind = _asked_once(key, known)
    tid, at, known = tid[order], at[order], known[order]
    # Known windows need no answer: only those that tell others stay, and hold no place of their own.
    stay = ~(known & (kind == PASS))
    return pa.RecordBatch.from_arrays([_signed(deal[stay]), pa.array(kind[stay]), pa.array(tid[stay]),
                                       pa.array(np.where(known, np.int32(-1), at)[stay])], names=["key", "kind", "tid", "at"])


def _found_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(tid, a, b)`` of the windows that occur twice."""
    for table in stream_groups(batches, "key"):
        at = table.column("at").to_numpy()
        hit = (_answers(table) > 0) & (at >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(table.column("tid").to_numpy()[hit]), pa.array(at[hit]), pa.array(at[hit] + np.int32(LENGTH))],
                                         names=["tid", "a", "b"])


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(tid, spans)`` with touching spans joined, from rows sorted by ``tid, a``."""
    for table in stream_groups(batches, "tid"):
        tid, a, b = (table.column(c).to_numpy().astype(np.int64) for c in ("tid", "a", "b"))
        starts = sorted_runs(tid)
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        shift = owner * (int(b.max()) + 2)              # one number line for all texts
        reach = np.maximum.accumulate(b + shift)
        opens = np.ones(len(a), bool)
        opens[1:] = a[1:] + shift[1:] > reach[:-1]
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(a)) - 1
        span = pa.StructArray.from_arrays([pa.array(a[first].astype(np.int32)), pa.array((reach[last] - shift[last]).astype(np.int32))], ["a", "b"])
        border = np.searchsorted(owner[first], np.arange(len(starts))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(tid[starts[:-1]]), pa.ListArray.from_arrays(pa.array(border), span)], names=["tid", "spans"])


def repeats(texts: DataFrame) -> DataFrame:
    """``(tid, spans)``: maximal stretches ``(a, b)`` of each distinct text that are repeated somewhere.

    ``texts`` has ``tid`` and ``text``, one row for every document.
    """
    scratch = Scratch(texts.sparkSession)
    parts = regions(scratch, texts)
    scratch.tidy()
    found = classes(scratch, parts)
    listed = found.groupBy("seg").agg(F.collect_list(F.struct("i", "class")).alias("cuts"))
    around = arrow_map(parts.join(listed, "seg").select("seg", "tid", "start", "data", "cuts"), _around,
                       "key bigint, kind tinyint, class bigint, windows int, tid bigint, lo int, seg bigint")
    around = scratch.keep(around.repartition("key").sortWithinPartitions("key").mapInArrow(
        _settle, "class bigint, windows int, tid bigint, lo int, seg bigint, state tinyint"))
    scratch.drop(found)
    whole = around.where("state > 0").select("tid", F.col("lo").alias("a"), (F.col("lo") + F.col("windows") - 1 + LENGTH).alias("b"))
    apart = around.where("state < 2")
    unsettled = (apart.groupBy("class").agg(F.count("*").alias("kinds"), F.min("state").alias("least"))
                 .where("kinds > 1 and least = 0").select("class"))
    ask = (apart.join(unsettled, "class", "left_semi").groupBy("seg")
           .agg(F.collect_list(F.struct("lo", "windows", "class", (F.col("state") > 0).alias("known"))).alias("cuts")))
    single = (arrow_map(parts.join(ask, "seg").select("tid", "start", "data", "cuts"), _single_windows,
                        "key bigint, kind tinyint, tid bigint, at int")
              .repartition("key").sortWithinPartitions("key").mapInArrow(_found_windows, "tid bigint, a int, b int"))
    copies = (texts.groupBy("tid").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("b"))
              .where(f"n > 1 and b >= {LENGTH}").select("tid", F.lit(0).alias("a"), "b"))
    out = materialise(whole.unionByName(single).unionByName(copies).repartition("tid").sortWithinPartitions("tid", "a")
                      .mapInArrow(_merge_spans, "tid bigint, spans array<struct<a:int,b:int>>"))
    scratch.drop(parts, around)
    return out


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def with_spans(docs: DataFrame, out: str = "spans") -> DataFrame:
    """``docs`` with the repeated byte spans of each text as the last column (NULL: none)."""
    tid = free_name(docs, "_tid")
    keyed = docs.withColumn(tid, F.xxhash64(whole_text()))
    found = repeats(keyed.select(F.col(tid).alias("tid"), whole_text().alias("text")))
    found = found.select(F.col("tid").alias(tid), F.col("spans").alias(out))
    return keyed.join(found, tid, "left").drop(tid)


def digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of each document."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[] for _ in range(4)]
        for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
            gone = merged(spans)
            kept = _kept(text, gone)
            for column, value in zip(rows, (len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())):
                column.append(value)
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows)],
                                          names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    marked = with_spans(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")))
    return arrow_map(marked.select("doc_id", "text", "spans"), run,
                     "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def _kept(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in gone for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated bytes; ``n_chars`` follows the text.

    Where a cut falls inside a character of several bytes, the rest of that character goes too.
    """
    spans = free_name(docs, "_spans")
    place = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(place)
        texts = [t if t is None or not s else _kept(t, merged(s)).decode(errors="ignore").encode()
                 for t, s in zip(column.cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
        columns = [*batch.columns[:-1]]
        columns[place] = pa.array(texts, pa.binary()).cast(column.type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    done = arrow_map(with_spans(docs, spans), run, docs.schema)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                               .otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return done
