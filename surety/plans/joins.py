"""Joins of large row tables with smaller fitted tables, safe under skew."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.session import materialise

#: Fitted tables are broadcast up to this size and shuffle-joined beyond it.
BROADCAST_BYTES = 64 << 20
#: A join key with more rows than this is split into shares of about so many rows.
SHARE_ROWS = 1_000_000
#: Rows with a missing key are dealt to so many tasks.
MISSING_SHARES = 4096


def row_bytes(schema: T.StructType) -> Column:
    """About how many bytes a row takes in memory, nested arrays included."""
    def of(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") + 16
        if isinstance(kind, T.ArrayType):
            inner = kind.elementType
            if isinstance(inner, (T.ArrayType, T.StructType, T.StringType, T.MapType)):
                size = F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + of(x, inner))
            else:
                size = F.size(c).cast("bigint") * 8
            return F.coalesce(size, F.lit(0)) + 16
        if isinstance(kind, T.StructType):
            return reduce(add, [of(c[f.name], f.dataType) for f in kind.fields], F.lit(8).cast("bigint"))
        if isinstance(kind, T.MapType):
            return of(F.map_keys(c), T.ArrayType(kind.keyType)) + of(F.map_values(c), T.ArrayType(kind.valueType))
        return F.lit(8).cast("bigint")
    return reduce(add, [of(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields], F.lit(8).cast("bigint"))


def bounded(table: DataFrame, limit: int | None = None) -> DataFrame:
    """Materialise a fitted table and mark it for broadcast only if its bytes allow it.

    A larger table is returned without a hint: Spark then shuffles, and adaptive execution
    splits the partitions a dominant key makes large.
    """
    table = materialise(table)
    size = table.agg(F.sum(row_bytes(table.schema))).first()[0] or 0
    return F.broadcast(table) if size <= (BROADCAST_BYTES if limit is None else limit) else table


def attach_groups(rows: DataFrame, table: DataFrame, keys: Sequence[str],
                  how: str = "left") -> DataFrame:
    """Join per-group values onto rows, broadcasting the group table when it is small."""
    return rows.join(bounded(table), list(keys), how)


def attach_cells(rows: DataFrame, cells: DataFrame, parts: DataFrame, keys: Sequence[str],
                 n: str = "n", how: str = "left",
                 salt_by: Sequence[str] | None = None) -> DataFrame:
    """Join values computed per distinct ``keys`` back onto the rows they came from.

    ``cells`` has one row per key with its row count ``n``; ``parts`` is the materialised
    table it was computed from. A key with more than ``SHARE_ROWS`` rows is cut into as many
    shares as its count asks for: its rows are dealt by a hash and its cell is repeated once per
    share. Rows with a missing key match nothing; they are dealt by their hash alone.
    """
    keys = list(keys)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    missing = reduce(or_, [F.col(k).isNull() | F.isnan(F.col(k))
                           if isinstance(kinds[k], (T.DoubleType, T.FloatType)) else F.col(k).isNull()
                           for k in keys])
    if salt_by is None:
        salt_by = [k for k, t in kinds.items()
                   if not isinstance(t, (T.MapType, T.ArrayType, T.StructType))]
    zero, mark = F.lit(0).cast("bigint"), F.xxhash64(*[F.col(f"`{c}`") for c in salt_by])
    salt, shares = zero, F.lit(1).cast("bigint")
    if (parts.agg(F.max(n)).first()[0] or 0) > SHARE_ROWS:
        shares = F.ceil(F.col(n) / F.lit(SHARE_ROWS)).cast("bigint")
        hot = parts.where(F.col(n) > SHARE_ROWS).select(*keys, shares.alias("_shares"))
        rows = rows.join(bounded(hot), keys, "left")
        salt = F.pmod(mark, F.coalesce("_shares", F.lit(1).cast("bigint")))
    salted = rows.withColumn("_salt", F.when(missing, F.pmod(mark, F.lit(MISSING_SHARES)) - MISSING_SHARES)
                             .otherwise(salt)).drop("_shares")
    repeated = cells.withColumn("_salt", F.explode(F.sequence(zero, shares - 1))).drop(n)
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def require_none(df: DataFrame, message: str) -> None:
    """Raise when ``df`` has any row; the message shows the first one."""
    bad = df.limit(1).collect()
    if bad:
        raise ValueError(f"{message}: {bad[0].asDict()}")
