"""Pixel-level metrics over score maps and ground-truth masks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.functions.columns import on_grid
from surety.operators.metrics import rank_metrics_of
from surety.plans.joins import attach_groups
from surety.plans.ranking import cells, ranked_cells, with_pooled
from surety.session import materialise


#: Pixels that a task works on before it passes on what it found.
PIXELS = 1 << 18


def sized(masks: DataFrame, row: str) -> DataFrame:
    """``_mask, _mh, _mw`` of each mask; the size is NULL where the table does not state it."""
    def side(name: str) -> Column:
        return F.col(name).cast("int") if name in masks.columns else F.lit(None).cast("int")

    return masks.select(row, F.col("mask").cast("array<tinyint>").alias("_mask"),
                        side("h").alias("_mh"), side("w").alias("_mw"))


def with_masks(maps: DataFrame, masks: DataFrame, row: str = "image_id") -> DataFrame:
    """Maps with ``mask`` and ``labels``, the region number of each pixel.

    A mask of another size is brought to the map's grid (nearest pixel). Regions are found once
    for each mask and stored; an image without a mask has zeros and is never labelled.
    """
    grids = maps.select(row, "h", "w").distinct()
    given = sized(masks, row).withColumnsRenamed({"_mask": "_given"})
    fitted = given.join(grids, row).select(row, "h", "w", on_grid(
        F.col("_given"), F.col("_mh"), F.col("_mw"), F.col("h"), F.col("w")).alias("mask"))
    labelled = materialise(regions(fitted).select(
        row, "h", "w", F.col("mask").alias("_mask"), F.col("labels").alias("_labels")))

    def zeros(kind: str) -> Column:
        return F.transform("values", lambda v: F.lit(0).cast(kind))

    return (maps.join(labelled, [row, "h", "w"], "left")
            .withColumn("mask", F.coalesce("_mask", zeros("tinyint")))
            .withColumn("labels", F.coalesce("_labels", zeros("int"))).drop("_mask", "_labels"))


def pixel_auroc(maps: DataFrame, group: Sequence[str], pooled: str | None = None) -> DataFrame:
    """AUROC over all pixels of a group. Exact: pixels collapse to distinct scores first.

    With ``pooled``, a column, each of its values is a ``group`` and so is all of them together;
    the collapsed scores are counted for both, not the pixels.
    """
    pixels = maps.select(*group, *([pooled] if pooled else []),
                         F.explode(F.arrays_zip("values", "mask")).alias("_p")).withColumns({
        "score": F.col("_p.values").cast("double"), "_pos": (F.col("_p.mask") > 0).cast("int")})
    group = list(group)
    sums = {"n": F.lit(1), "n_pos": F.col("_pos")}
    if pooled:
        cells_ = cells(pixels, [*group, pooled], "score", sums)
        pixels, group = with_pooled(cells_, pooled), [*group, "group"]
        sums = {"n": F.col("n"), "n_pos": F.col("n_pos")}
    return rank_metrics_of(ranked_cells(pixels, group, "score", sums), group).select(
        *group, F.col("n").alias("n_pixels"), F.col("auroc").alias("pixel_auroc"))


def _region_numbers(inside: np.ndarray) -> np.ndarray:
    """4-connected regions of one image, numbered in scan order.

    Works on horizontal runs: runs of neighbouring rows that share a column are united, so the
    time is linear in the pixels however long or winding a region is.
    """
    h, w = inside.shape
    step = np.diff(np.pad(inside, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    parent = list(range(len(row)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1)).tolist()
    lo, hi = start.tolist(), end.tolist()
    for r in range(1, h):
        above, here = first[r - 1], first[r]
        while above < first[r] and here < first[r + 1]:
            if lo[above] < hi[here] and lo[here] < hi[above]:
                a, b = root(above), root(here)
                parent[max(a, b)] = min(a, b)
            if hi[above] < hi[here]:
                above += 1
            else:
                here += 1
    roots = np.array([root(i) for i in range(len(row))], dtype=np.int64)
    number = np.unique(roots, return_inverse=True)[1] + 1
    out = np.zeros((h, w), dtype=np.int32)
    out[inside] = np.repeat(number, end - start)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def region_labels(masks: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """4-connected region number of each pixel of a mask (0 is background), in scan order.

    Takes mask, height and width. Labels are passed on every :data:`PIXELS` pixels, however many masks come at once.
    """
    for mask, height, width in masks:
        found, pixels = [], 0
        for m, h, w in zip(mask, height, width):
            found.append(_region_numbers(np.asarray(m).reshape(int(h), int(w)) > 0).ravel())
            pixels += len(found[-1])
            if pixels >= PIXELS:
                yield pd.Series(found)
                found, pixels = [], 0
        if found:
            yield pd.Series(found)


def regions(masks: DataFrame) -> DataFrame:
    """Masks with ``labels``: the region number of each pixel."""
    return masks.withColumn("labels", region_labels("mask", "h", "w"))


def region_sizes(masks: DataFrame, row: str = "image_id") -> DataFrame:
    """Pixels per connected region, with the smallest pixel index as the region's anchor."""
    pixels = regions(masks).select(row, F.posexplode("labels").alias("_i", "region"))
    return pixels.where(F.col("region") > 0).groupBy(row, "region").agg(
        F.min("_i").alias("anchor"), F.count(F.lit(1)).alias("n_pixels"))


def _buckets(v: np.ndarray, high: float, low: float, steps: int) -> np.ndarray:
    """First of the falling thresholds from ``high`` to ``low`` that each value reaches."""
    thresholds = high + np.arange(steps + 2) * ((low - high) / float(steps))
    thresholds[steps:] = low
    near = np.ceil((high - v) / (high - low) * steps).astype(np.int64)
    # The estimate can be one off in floating point: settle it on the thresholds themselves.
    return np.where((near >= 1) & (v >= thresholds[np.maximum(near - 1, 0)]), near - 1,
                    np.where(v >= thresholds[near], near, near + 1))


def _bucket_counts(rows: DataFrame, group: list[str], row: str, steps: int) -> DataFrame:
    """``group, row, region, _b, _c``: pixels of each region that reach each threshold first.

    Counted map by map from its arrays, so pixels are never rows; missing pixels do not count. What
    is found is passed on every :data:`PIXELS` pixels, so memory does not follow the rows of a batch.
    """
    keys = [*group, row]
    schema = T.StructType([*[rows.schema[c] for c in keys], *T._parse_datatype_string("region int, _b int, _c bigint").fields])

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found: list[list[np.ndarray]] = [[], [], []]
        owner = []
        for i, (high, low, values, labels) in enumerate(zip(*(batch.column(c) for c in ("_hi", "_lo", "values", "labels")))):
            if not (values.is_valid and labels.is_valid):
                continue
            v = values.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            region = labels.values.to_numpy(zero_copy_only=False)
            known = ~np.isnan(v)
            bucket = _buckets(v[known], high.as_py(), low.as_py(), steps)
            cell, count = np.unique(region[known].astype(np.int64) * (steps + 2) + bucket, return_counts=True)
            for store, column in zip(found, (cell // (steps + 2), cell % (steps + 2), count)):
                store.append(column)
            owner.append(np.full(len(cell), i))
        if not owner:
            return None
        heads = batch.select(keys).take(pa.array(np.concatenate(owner)))
        kinds = (pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([*heads.columns, *[pa.array(np.concatenate(c), k) for c, k in zip(found, kinds)]], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("values")), 0).to_numpy(zero_copy_only=False))
            starts = np.append(np.unique(sizes // PIXELS, return_index=True)[1], batch.num_rows)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                out = counted(batch.slice(a, b - a))
                if out is not None:
                    yield out

    return rows.select(*keys, "_hi", "_lo", "values", "labels").mapInArrow(run, schema)


def pro_curve(maps: DataFrame, group: Sequence[str], n_thresholds: int = 200,
              row: str = "image_id") -> DataFrame:
    """False-positive rate and mean region overlap at falling thresholds.

    Thresholds are evenly spaced from the group's highest to its lowest score. Each pixel is
    put at the first threshold it reaches, so the sweep is a cumulative sum over at most
    ``n_thresholds`` buckets per group. Thresholds nothing new reaches are left out.
    """
    group = list(group)
    steps = n_thresholds - 1
    ranges = maps.groupBy(*group).agg(
        F.max(F.array_max("values")).cast("double").alias("_hi"),
        F.min(F.array_min("values")).cast("double").alias("_lo"))
    ranges = ranges.where(F.col("_hi") > F.col("_lo"))
    if "labels" not in maps.columns:
        maps = regions(maps)
    rows = attach_groups(maps, ranges, group, "inner")
    counts = _bucket_counts(rows, group, row, steps)
    whole = Window.partitionBy(*group, row, "region")   # at most one row per threshold
    shares = counts.withColumn("_share", F.when(
        F.col("region") > 0, F.col("_c") / F.sum("_c").over(whole)))
    per_bucket = shares.groupBy(*group, "_b").agg(
        F.coalesce(F.sum("_share"), F.lit(0.0)).alias("_share"),
        F.coalesce(F.sum(F.when(F.col("region") == 0, F.col("_c"))), F.lit(0)).alias("_normal"))
    upto = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*group)
    n_regions = F.round(F.sum("_share").over(total))
    normal = F.sum("_normal").over(total)
    return per_bucket.select(
        *group, F.col("_b").alias("threshold_idx"),
        F.when(normal > 0, F.sum("_normal").over(upto) / normal).alias("fpr"),
        F.when(n_regions > 0, F.sum("_share").over(upto) / n_regions).alias("pro"))


def pro_score(maps: DataFrame, group: Sequence[str], max_fpr: float = 0.3,
              n_thresholds: int = 200, row: str = "image_id") -> DataFrame:
    """Area under the overlap curve up to ``max_fpr``, normalised.

    The last overlap is held out to ``max_fpr``. NULL without a region or with constant maps.
    """
    group = list(group)
    curve = pro_curve(maps, group, n_thresholds, row)
    kept = curve.where((F.col("fpr") <= max_fpr) & F.col("pro").isNotNull())
    order = Window.partitionBy(*group).orderBy("threshold_idx")
    width = F.col("fpr") - F.lag("fpr").over(order)
    area = width * (F.col("pro") + F.lag("pro").over(order)) / F.lit(2.0)
    stats = kept.withColumn("_area", area).groupBy(*group).agg(
        F.coalesce(F.sum("_area"), F.lit(0.0)).alias("_area"), F.max("fpr").alias("_fpr"),
        F.max("pro").alias("_pro"), F.count(F.lit(1)).alias("_n"))
    tail = F.when(F.col("_fpr") < max_fpr, (F.lit(max_fpr) - F.col("_fpr")) * F.col("_pro"))
    value = (F.col("_area") + F.coalesce(tail, F.lit(0.0))) / F.lit(max_fpr)
    return stats.select(*group, F.when(tail.isNotNull() | (F.col("_n") > 1), value).alias("pro"))


def pixel_table(maps: DataFrame, masks: DataFrame, group: str = "category",
                row: str = "image_id") -> DataFrame:
    """Pixel AUROC and PRO per map kind, for each group and pooled."""
    keys = ["map_kind", "group"]
    # Regions are labelled before the maps are fanned out.
    maps = regions(with_masks(maps, masks, row))
    rows = with_pooled(maps, group)
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return (n.join(pixel_auroc(maps, ["map_kind"], group).drop("n_pixels"), keys, "left")
            .join(pro_score(rows, keys, row=row), keys, "left")
            .withColumnRenamed("group", "category"))
