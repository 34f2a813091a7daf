"""Window grids and dense score maps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.functions.columns import let
from surety.operators.neighbours import knn_distance
from surety.operators.scoring import score_mean_embedding

BOX = "struct<l: int, t: int, r: int, b: int>"
#: Map values that a task draws before it passes them on.
VALUES = 1 << 18


def window_boxes(size: Column, scales: Sequence[float] = (0.5, 0.3333),
                 stride: float = 0.5) -> Column:
    """Array of sliding-window boxes on a square image, row by row for each scale.

    The last row and column are moved to the edge. Sizes round half to even.
    """
    def boxes(w: Column, tops: Column) -> Column:
        return F.flatten(F.transform(tops, lambda t: F.transform(
            tops, lambda x: F.struct(x.alias("l"), t.alias("t"), (x + w).alias("r"),
                                     (t + w).alias("b")))))

    def grid(w: Column) -> Column:
        step = F.greatest(F.bround(w * F.lit(float(stride))), F.lit(1)).cast("int")
        last = (size - w).cast("int")
        tops = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), step)
        return let(F.when(F.element_at(tops, -1) != last, F.concat(tops, F.array(last)))
                   .otherwise(tops), lambda t: boxes(w, t))

    sides = [F.greatest(F.bround(size * F.lit(float(s))), F.lit(16)).cast("int") for s in scales]
    return F.concat(*[let(w, grid) for w in sides]).cast(f"array<{BOX}>")


def window_grid(images: DataFrame, size: str = "size",
                scales: Sequence[float] = (0.5, 0.3333), stride: float = 0.5) -> DataFrame:
    """One row per image and window: ``window_idx`` and ``box``."""
    return images.select("*", F.posexplode(window_boxes(F.col(size), scales, stride))
                         .alias("window_idx", "box"))


def bank_window_scores(windows: DataFrame, bank: DataFrame, k: int = 1,
                       positional: bool = True, group: str = "category",
                       row: str = "image_id") -> DataFrame:
    """Distance of each window to the ``k`` nearest normal windows of its group.

    ``positional`` compares only with the same grid position. Without any bank window the
    score is 0. Vectors are taken as they are.
    """
    keys = [group, "window_idx"] if positional else [group]
    out = knn_distance(windows, bank, keys, max(k, 1), windows.columns, row, unit=False, name="window_score")
    out = out.select(*windows.columns, "window_score")
    return out.withColumn("window_score", F.coalesce("window_score", F.lit(0.0)))


def text_window_scores(windows: DataFrame, text: DataFrame, tau: float,
                       group: str = "category") -> DataFrame:
    """Probability of "anomalous" for each window against the mean text templates."""
    return score_mean_embedding(windows, text, tau, group).withColumnRenamed(
        "anomaly_score", "window_score").drop("raw_score")


def resize_weights(size: int, out: int) -> np.ndarray:
    """``out x size`` triangle-filter weights; shrinking widens the filter to cover all pixels."""
    scale = size / out
    support = max(scale, 1.0)
    centre = (np.arange(out) + 0.5) * scale
    w = np.maximum(0.0, 1.0 - np.abs(np.arange(size)[None, :] + 0.5 - centre[:, None]) / support)
    return w / w.sum(axis=1, keepdims=True)


def _painted(boxes: np.ndarray, scores: np.ndarray, size: int) -> np.ndarray:
    """Mean score of the windows over each pixel, 0 where there is none.

    Each window is four corners of a difference array and prefix sums fill it in. Scores are added
    up as integers, scaled by a power of two that leaves room for their sum, so that taking a
    window away again leaves nothing behind. A pixel under a missing score is NaN.
    """
    known = np.isfinite(scores)
    largest = np.abs(scores[known]).max(initial=0.0) * max(len(scores), 1)
    shift = 61 - int(np.frexp(largest)[1])
    whole = np.rint(np.ldexp(np.where(known, scores, 0.0), shift)).astype(np.int64)
    corners = np.zeros((3, size + 1, size + 1), np.int64)
    left, top, right, bottom = np.clip(boxes, 0, size).T
    for plane, value in zip(corners, (whole, np.ones(len(scores), np.int64), (~known).astype(np.int64))):
        for y, x, sign in ((top, left, 1), (top, right, -1), (bottom, left, -1), (bottom, right, 1)):
            np.add.at(plane, (y, x), sign * value)
    total, seen, lost = corners.cumsum(axis=1).cumsum(axis=2)[:, :size, :size]
    dense = np.ldexp(total.astype(np.float64), -shift) / np.maximum(seen, 1)
    dense[lost > 0] = np.nan
    return dense


def _few(frames: Iterator[pd.DataFrame], values: int) -> Iterator[pd.DataFrame]:
    """The rows in runs of at most :data:`VALUES` values, with so many ``values`` in each row."""
    step = max(VALUES // max(values, 1), 1)
    for frame in frames:
        for a in range(0, len(frame), step):
            yield frame.iloc[a:a + step]


def paint(windows: DataFrame, size: int, out_size: int | None = None,
          keys: Sequence[str] = ("image_id",), score: str = "window_score") -> DataFrame:
    """Average the scores of the windows over each pixel; uncovered pixels are 0.

    The windows of one image are a fixed small grid, so they are brought together in one row
    and painted in time linear in windows plus pixels. The result is resized to ``out_size``.
    Pixels under a missing score are NaN.
    """
    keys = list(keys)
    out = out_size or size
    gathered = windows.groupBy(*keys).agg(F.sort_array(F.collect_list(
        F.struct(F.col("window_idx"), F.array("box.l", "box.t", "box.r", "box.b").alias("box"),
                 F.col(score).cast("double").alias("s")))).alias("_w")).select(
        *keys, F.flatten("_w.box").alias("_boxes"), F.transform("_w.s", lambda s: F.coalesce(s, F.lit(float("nan")))).alias("_scores"))
    schema = T.StructType([*[gathered.schema[c] for c in keys],
                           T.StructField("h", T.IntegerType()),
                           T.StructField("w", T.IntegerType()),
                           T.StructField("values", T.ArrayType(T.DoubleType()))])
    weights = resize_weights(size, out) if out != size else None

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _few(frames, size * size):
            painted = []
            for boxes, scores in zip(frame["_boxes"], frame["_scores"]):
                dense = _painted(np.asarray(boxes, np.int64).reshape(-1, 4), np.asarray(scores, float), size)
                if weights is not None:
                    dense = weights @ dense @ weights.T
                painted.append(dense.ravel())
            yield frame[keys].assign(h=out, w=out, values=painted)

    return gathered.mapInPandas(draw, schema)


def resize_maps(maps: DataFrame, out_size: int) -> DataFrame:
    """Resize square maps to ``out_size`` with the triangle filter."""
    schema = maps.schema

    def resize(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[int, np.ndarray] = {}
        for frame in _few(frames, out_size * out_size):
            resized = []
            for size, values in zip(frame["h"], frame["values"]):
                if size not in cache:
                    cache[size] = resize_weights(int(size), out_size)
                square = np.asarray(values, dtype=float).reshape(size, size)
                resized.append((cache[size] @ square @ cache[size].T).ravel())
            frame = frame.copy()
            frame["values"] = resized
            frame["h"] = frame["w"] = out_size
            yield frame

    return maps.mapInPandas(resize, schema)


def build_maps(windows: DataFrame, bank: DataFrame | None, text: DataFrame | None, size: int,
               out_size: int, k: int = 1, tau: float = 0.01,
               positional: bool = True) -> DataFrame:
    """Bank and text maps of every image as ``(image_id, category, map_kind, h, w, values)``.

    A kind whose input is missing is left out.
    """
    kinds = []
    keys = ["image_id", "category"]
    if bank is not None:
        kinds.append(paint(bank_window_scores(windows, bank, k, positional), size, out_size,
                           keys).withColumn("map_kind", F.lit("bank")))
    if text is not None:
        kinds.append(paint(text_window_scores(windows, text, tau), size, out_size,
                           keys).withColumn("map_kind", F.lit("text")))
    if not kinds:
        raise ValueError("neither a window bank nor text embeddings are given")
    out = kinds[0]
    for more in kinds[1:]:
        out = out.unionByName(more)
    return out
