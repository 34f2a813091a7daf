"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.session import checkpoint_dir, materialise

#: Bytes of text that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 18
#: Bytes of rows that a mapped function gets at once.
SLICE_BYTES = 4 << 20


def whole_text(column: str = "text") -> Column:
    """The text with NULL read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def schema_with(df: DataFrame, name: str, kind: str) -> T.StructType:
    """The schema of ``df`` with one more column at its end."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(f"`{name}` {kind}").fields])


def utf8_steps(texts: pa.Array, budget: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into runs of rows of about ``budget`` bytes.

    Yields ``(first, end, bytes, offsets)``: rows ``first..end``, their UTF-8 bytes as uint8 and
    ``end - first + 1`` offsets into them. Nothing is copied.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets_buffer, data = texts.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + budget, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, raw[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def slices(batch: pa.RecordBatch, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``budget`` bytes each."""
    rows = max(1, int(batch.num_rows * budget / max(batch.nbytes, 1)))
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def arrow_map(df: DataFrame, per_slice: Callable[[pa.RecordBatch], pa.RecordBatch | None],
              schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with a function of about ``SLICE_BYTES`` of rows; it never gets an empty slice."""
    names = df.columns
    if any("." in c for c in names):
        # ``mapInArrow`` reads a dot in a column's name as a field of a struct.
        df = df.toDF(*[f"_{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.rename_columns(names)):
                out = per_slice(part)
                if out is not None and out.num_rows:
                    yield out
    return df.mapInArrow(run, schema)


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for; ``new`` lists the latest."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        self.new.append(key)
        return number


def tidy(spark: SparkSession) -> None:
    """Let go of plans that nothing refers to, and so of their shuffle files and checkpoints."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables written to the shared checkpoint folder in place of long lineages.

    A chain of many sorts would leave all its shuffles and tables on disk until the end.
    ``drop`` deletes tables that are read no more, and lets Spark's cleaner remove the shuffle
    files behind them; a lost executor only ever goes back to the latest table.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            _, path = self.paths.pop(id(table))
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        self.tidy()

    def tidy(self) -> None:
        tidy(self.spark)


def sorted_runs(key: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in ``key``, with its length at the end."""
    if not len(key):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]).astype(np.int64)


def stream_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroup a stream sorted by ``key`` so that no key is cut between two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        if held and held[-1].column(key)[-1].as_py() != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = int(sorted_runs(values)[-2])
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes under the given links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = np.minimum(new, new[new])
        if np.array_equal(new, root):
            return root
        root = new


def components(links: DataFrame) -> DataFrame:
    """Connected components: ``(node, root)`` for every node of ``links(a, b)``.

    ``root`` is the smallest node of the component. Alternates large-star and small-star steps
    (each keeps the components and shortens paths) until the links are stars: no node has two
    links to smaller ones, and none that others link to has one. Each step is checkpointed, so a
    lost executor replays one step, and lets go of what the step before left on disk. A node with
    many neighbours is pre-aggregated before the shuffle; what comes of that is stored, so that
    the join back shuffles both of its sides and adaptive execution can split the node's links.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")

    def stars(df: DataFrame) -> bool:
        ends = df.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(df.select("b", F.lit(0)))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least")).where(
            "up > 1 or up = 1 and least = 0").isEmpty()

    def step(df: DataFrame) -> DataFrame:
        both = df.union(df.select("b", "a"))
        low = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = (both.join(low, "a").where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        large = materialise(large)
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b"))).where("a <> b"))
        return materialise(small.select(a, b).distinct())

    now = materialise(links.where("a <> b").select(a, b).distinct())
    tidy(now.sparkSession)
    while not stars(now):
        now = step(now)
        tidy(now.sparkSession)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
