"""Parquet tables for embeddings, generations, text embeddings and maps."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.session import materialise

SHARD_KEYS = ["model_tag", "category", "split", "kind", "corruption", "severity", "extra"]
EMBEDDING_SCHEMA = T.StructType([
    T.StructField("image_id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    *[T.StructField(k, T.LongType() if k == "severity" else T.StringType())
      for k in SHARD_KEYS]])
SAMPLE_TYPE = T.ArrayType(T.StructType([
    T.StructField("vote", T.IntegerType()), T.StructField("observation", T.StringType()),
    T.StructField("defect_type", T.StringType()), T.StructField("location", T.StringType()),
    T.StructField("confidence", T.StringType()), T.StructField("text", T.StringType())]))


def shard_tag(*parts: Column | str) -> Column:
    """Ten hex digits that name a combination of settings."""
    joined = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p))
                                for p in parts])
    return F.substring(F.sha1(joined), 1, 10)


class EmbeddingStore:
    """Embeddings partitioned by shard key, so a load reads only its partitions."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _table(self) -> DataFrame:
        return self.spark.read.schema(EMBEDDING_SCHEMA).parquet(self.path)

    def exists(self) -> bool:
        """Whether anything has been saved under the path yet."""
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(target)

    def save(self, df: DataFrame, **keys) -> None:
        """Write embeddings; shard keys come from ``keys`` or from columns of ``df``.

        Shards that ``df`` holds are replaced, so a job that runs again leaves no second copy;
        other shards stay as they are.
        """
        self._write(df, keys, "overwrite")

    def top_up(self, df: DataFrame, **keys) -> None:
        """Append the rows of ``df`` whose image its shard does not hold yet."""
        out = self._shaped(df, keys)
        if self.exists():
            out = out.join(self._table().select("image_id", *SHARD_KEYS),
                           ["image_id", *SHARD_KEYS], "left_anti")
        # The table is read and appended to, so the rows are fixed first.
        self._write(materialise(out), {}, "append")

    def _shaped(self, df: DataFrame, keys: dict) -> DataFrame:
        defaults = {"corruption": "none", "severity": 0, "extra": ""}
        columns = {}
        for name in SHARD_KEYS:
            if name in keys:
                columns[name] = F.lit(keys[name])
            elif name not in df.columns:
                if name not in defaults:
                    raise ValueError(f"shard key {name!r} is missing")
                columns[name] = F.lit(defaults[name])
        out = df.withColumns(columns).select(*[
            F.col(f.name).cast(f.dataType).alias(f.name) for f in EMBEDDING_SCHEMA])
        if out.where(F.col("image_id").isNull() | F.col("embedding").isNull()).limit(1).count():
            raise ValueError("every image needs an id and an embedding")
        # An empty partition value would be read back as NULL.
        return out.withColumn("extra", F.when(F.col("extra") != "", F.col("extra"))
                              .otherwise(F.lit("-")))

    def _write(self, df: DataFrame, keys: dict, mode: str) -> None:
        # Rows of a shard come together, large shards in several files of a common size.
        dealt = self._shaped(df, keys).hint("rebalance", *SHARD_KEYS)
        (dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic")
         .partitionBy(*SHARD_KEYS).parquet(self.path))

    def _select(self, keys: dict) -> DataFrame:
        table = self._table()
        for name, value in keys.items():
            if name not in SHARD_KEYS:
                raise KeyError(f"unknown shard key {name!r}")
            if name == "extra" and value == "":
                value = "-"
            table = table.where(F.col(name) == F.lit(value))
        return table

    def has(self, **keys) -> bool:
        return self.exists() and self._select(keys).limit(1).count() > 0

    def load(self, **keys) -> DataFrame:
        """The rows of a shard selection; an empty selection raises."""
        if not self.has(**keys):
            raise FileNotFoundError(f"no stored embeddings for {keys}")
        return self._select(keys).select("image_id", "embedding")

    def missing(self, index: DataFrame, **keys) -> DataFrame:
        """Index rows that still need an embedding in that shard selection."""
        if not self.exists():
            return index
        return index.join(self._select(keys).select("image_id"), "image_id", "left_anti")

    def covers(self, index: DataFrame, **keys) -> bool:
        return self.missing(index, **keys).limit(1).count() == 0


def missing_rows(index: DataFrame, stored: DataFrame, row: str = "image_id") -> DataFrame:
    """Index rows without a stored embedding."""
    return index.join(stored.select(row), row, "left_anti")


def pack_generations(parsed: DataFrame, key: str = "image_id",
                     order: str = "sample_idx") -> DataFrame:
    """One JSON array of samples per image; the samples of an image are few."""
    fields = SAMPLE_TYPE.elementType.fieldNames()
    samples = F.array_sort(F.collect_list(F.struct(order, *fields)))
    plain = F.transform(samples, lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    return parsed.groupBy(key).agg(F.to_json(plain).alias("generations"))


def write_generations(parsed: DataFrame, path: str, mode: str = "error") -> None:
    pack_generations(parsed).write.mode(mode).json(path)


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    """Images with their JSON array of samples."""
    return spark.read.schema("image_id string, generations string").json(path)


def explode_generations(packed: DataFrame, key: str = "image_id") -> DataFrame:
    """One row per sample; an image without samples keeps one row of NULLs."""
    samples = F.from_json("generations", SAMPLE_TYPE)
    return packed.select(key, F.posexplode_outer(samples).alias("sample_idx", "_s")).select(
        key, "sample_idx", "_s.*")


def records_with_generations(records: DataFrame, packed: DataFrame,
                             key: str = "image_id") -> DataFrame:
    """Records with their packed samples; a record without any has an empty list."""
    return records.join(packed, key, "left").withColumn(
        "generations", F.coalesce("generations", F.lit("[]")))


def write_table(df: DataFrame, path: str, partition_by: list[str], mode: str = "error") -> None:
    """Maps and text embeddings: Parquet partitioned by their leading keys."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


class CoPartitioned:
    """Tables under one path that share their buckets of ``row``, so joins on it shuffle nothing.

    A bucket is one sorted file. The tables are registered in the session's catalog under names of
    their own; another session registers them again from the path.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 512, row: str = "image_id") -> None:
        self.spark, self.path, self.buckets, self.row = spark, path, buckets, row

    def _place(self, name: str) -> tuple[str, str]:
        folder = f"{self.path}/{name}-{self.buckets}"
        return folder, f"surety_{hashlib.sha256(folder.encode()).hexdigest()[:24]}"

    def save(self, name: str, df: DataFrame) -> None:
        """Write or replace a table. Rows without an id are kept, in a bucket like any other."""
        folder, table = self._place(name)
        self.spark.sql(f"DROP TABLE IF EXISTS `{table}`")
        (df.repartition(self.buckets, self.row).write.mode("overwrite").option("path", folder)
         .bucketBy(self.buckets, self.row).sortBy(self.row).saveAsTable(table))

    def load(self, name: str) -> DataFrame:
        folder, table = self._place(name)
        if not self.spark.catalog.tableExists(table):
            fields = self.spark.read.parquet(folder).schema.fields
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
            self.spark.sql(f"CREATE TABLE `{table}` ({columns}) USING parquet CLUSTERED BY (`{self.row}`) SORTED BY (`{self.row}`) "
                           f"INTO {self.buckets} BUCKETS LOCATION '{folder}'")
        return self.spark.table(table)
