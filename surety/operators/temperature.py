"""One-parameter logistic recalibration, fitted on labels (a labelled baseline)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.functions.columns import clip, finite, logistic, logit

#: ln T is searched on this closed interval (fixed values).
LOG_T = (math.log(1e-2), math.log(1e2))


def fit_temperature(df: DataFrame, score: str = "anomaly_score", label: str = "label",
                    points: int = 21, rounds: int = 7) -> float:
    """Minimise the negative log-likelihood of ``sigmoid(logit(p) / T)`` over ``T``.

    Each round evaluates a grid of ``ln T`` in one aggregation, then narrows the
    grid to the cells around the best point. Rows are collapsed to distinct scores first.
    """
    base = (df.where(finite(F.col(score))).groupBy(score)
            .agg(F.sum(label).alias("_pos"), F.count(F.lit(1)).alias("_n"))
            .select(logit(F.col(score)).alias("_z"), "_pos", "_n").persist())
    try:
        pos, n = base.agg(F.sum("_pos"), F.sum("_n")).first()
        if not n or pos in (0, n):
            raise ValueError("temperature scaling needs both classes present")
        lo, hi = LOG_T
        best = 0.0

        def loss(log_t: float) -> Column:
            p = clip(logistic(F.col("_z") / F.lit(math.exp(log_t))), 1e-12, 1.0 - 1e-12)
            return F.sum(-(F.col("_pos") * F.log(p)
                           + (F.col("_n") - F.col("_pos")) * F.log(F.lit(1.0) - p)))

        for _ in range(rounds):
            grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
            losses = base.agg(*[loss(t).alias(f"l{i}") for i, t in enumerate(grid)]).first()
            best = grid[min(range(points), key=lambda i: (losses[i], i))]
            i = grid.index(best)
            lo, hi = grid[max(i - 1, 0)], grid[min(i + 1, points - 1)]
        return math.exp(best)
    finally:
        base.unpersist()


def apply_temperature(df: DataFrame, temperature: float, score: str = "anomaly_score",
                      name: str = "p_temperature") -> DataFrame:
    return df.withColumn(name, logistic(logit(F.col(score)) / F.lit(float(temperature))))
