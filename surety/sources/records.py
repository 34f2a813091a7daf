"""The record table: schema, checks, reading, writing, signal columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The core columns of a record, in order.
CORE_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("scorer_name", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("defect_type", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("image_id", T.StringType()),
    T.StructField("label", T.LongType()),
    T.StructField("split", T.StringType()),
    T.StructField("subset_tag", T.StringType()),
    T.StructField("corruption", T.StringType()),
    T.StructField("severity", T.LongType()),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("raw_score", T.DoubleType()),
    T.StructField("parse_ok", T.BooleanType()),
    T.StructField("n_valid_votes", T.LongType()),
])
CORE = CORE_SCHEMA.fieldNames()
KEY = ["scorer_name", "image_id", "corruption", "severity"]
SLACK = 1e-9


def empty_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CORE_SCHEMA)


def finalize(df: DataFrame, run: Mapping[str, object]) -> DataFrame:
    """Stamp the run's columns, fill missing core columns, put the core first.

    ``run`` gives ``run_id``, ``scorer_name``, ``model_id``, ``subset_tag``, ``corruption`` and
    ``severity``; a ``scorer_name`` already in the frame is kept.
    """
    stamped = {k: F.lit(v) for k, v in run.items()
               if not (k == "scorer_name" and k in df.columns)}
    defaults = {"parse_ok": F.lit(True), "n_valid_votes": F.lit(1)}
    columns = []
    for field in CORE_SCHEMA:
        if field.name in stamped:
            c = stamped[field.name]
        elif field.name in df.columns:
            c = F.col(field.name)
        elif field.name in defaults:
            c = defaults[field.name]
        elif isinstance(field.dataType, T.StringType):
            c = F.lit("")
        else:
            c = F.lit(None)
        columns.append(c.cast(field.dataType).alias(field.name))
    return df.select(*columns, *[F.col(c) for c in df.columns if c not in CORE])


def violations(df: DataFrame) -> DataFrame:
    """``(rule, n)`` for every broken rule; empty for a valid table.

    Row rules are one aggregation. Duplicate keys are counted after a partial count per key.
    """
    missing = [c for c in CORE if c not in df.columns]
    if missing:
        return df.sparkSession.createDataFrame(
            [(f"missing column {c}", 1) for c in missing], "rule string, n long")
    score, label = F.col("anomaly_score"), F.col("label")
    inside = score.between(-SLACK, 1.0 + SLACK) & ~F.isnan(score)
    rules = {
        "label must be 0 or 1": F.count(F.when(~F.coalesce(label.isin(0, 1), F.lit(False)), 1)),
        "score outside [0, 1]": F.count(F.when(
            F.col("parse_ok") & ~F.coalesce(inside, F.lit(False)), 1)),
    }
    rows = df.agg(*[c.alias(r) for r, c in rules.items()]).unpivot(
        [], list(rules), "rule", "n")
    twice = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("duplicate key").alias("rule"), "n")
    return rows.unionByName(twice).where(F.col("n") > 0)


def validate(df: DataFrame) -> DataFrame:
    """Return the table, or raise with every broken rule."""
    broken = violations(df).collect()    # at most a few rows
    if broken:
        raise ValueError("invalid records: " + "; ".join(f"{r['rule']} ({r['n']})" for r in broken))
    return df


def write_records(df: DataFrame, path: str, mode: str = "error") -> str:
    """Validate, then write Parquet (or CSV with a header when the path ends in .csv)."""
    writer = validate(df).write.mode(mode)
    if path.endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path


def read_records(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """Read Parquet and CSV record tables together; columns are matched by name.

    Core columns have fixed types; other CSV columns whose name starts with ``u_`` are numbers.
    A missing path raises.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no record paths given")
    types = {f.name: f.dataType for f in CORE_SCHEMA}
    out = None
    for path in paths:
        if path.rstrip("/").endswith(".csv"):
            part = spark.read.option("header", True).csv(path)
            part = part.select(*[
                F.col(c).cast(types.get(c, T.DoubleType() if c.startswith("u_")
                                        else T.StringType())).alias(c) for c in part.columns])
        else:
            part = spark.read.parquet(path)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if "parse_ok" in out.columns:
        out = out.withColumn("parse_ok", F.col("parse_ok").cast("boolean"))
    return out


def signal_columns(df: DataFrame) -> list[str]:
    """Names of the uncertainty signals in the table, sorted."""
    return sorted(c for c in df.columns if c.startswith("u_"))


def signals_long(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One ``(keys, signal, value)`` row per signal."""
    names = signal_columns(df)
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    return wide.unpivot(list(keys), names, "signal", "value")
