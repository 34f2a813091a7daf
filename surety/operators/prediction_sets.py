"""Two-sided conformal prediction sets over {normal, anomalous}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.functions.columns import finite, ratio, uniform
from surety.operators.conformal import GROUP, ROW, SCORE, pool_counts, pvalue
from surety.plans.joins import require_none
from surety.plans.ranking import with_pooled

#: Set size -> uncertainty (fixed values): rejecting both labels warns most.
SET_SIZE_UNCERTAINTY = {1: 0.0, 2: 0.5, 0: 1.0}


def set_size_uncertainty(size: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in SET_SIZE_UNCERTAINTY.items():
        out = F.when(size == k, F.lit(v)).otherwise(out)
    return out


def prediction_sets(test: DataFrame, normal_cal: DataFrame, anomaly_cal: DataFrame,
                    delta: float = 0.05, score: str = SCORE, group: str = GROUP,
                    randomized: bool = False, seed: int = 0, row: str = ROW) -> DataFrame:
    """Keep each label whose p-value exceeds ``delta``.

    A high score conforms badly to "normal" and a low one badly to "anomalous". A group
    without a pool has no p-value on that side and that label is rejected.
    """
    if "label" in normal_cal.columns:
        require_none(normal_cal.where(F.col("label") != 0).select(group, "label"),
                     "the normal calibration pool must contain only normal rows")
    pools = {"_norm": normal_cal.where(finite(F.col(score))),
             "_anom": anomaly_cal.where(finite(F.col(score)))}
    counted = pool_counts(test, pools, score, group)
    u_n = uniform(seed, F.lit("normal"), row) if randomized else None
    u_a = uniform(seed, F.lit("anomalous"), row) if randomized else None
    keep_n = F.coalesce(F.col("p_normal") > delta, F.lit(False))
    keep_a = F.coalesce(F.col("p_anomalous") > delta, F.lit(False))
    size = F.col("set_size")
    return (counted
            .withColumns({
                "p_normal": pvalue(F.col("_norm_ge"), F.col("_norm_eq"), F.col("_norm_n"), u_n),
                "p_anomalous": pvalue(F.col("_anom_le"), F.col("_anom_eq"), F.col("_anom_n"),
                                      u_a)})
            .withColumns({
                "set_size": keep_n.cast("int") + keep_a.cast("int"),
                "set_label": F.when(keep_n & keep_a, "{normal,anomalous}")
                .when(keep_n, "{normal}").when(keep_a, "{anomalous}").otherwise("{}")})
            .withColumns({"u_set_size": set_size_uncertainty(size), "set_is_ood": size == 0})
            .drop(*[f"{p}_{k}" for p in pools for k in ("ge", "le", "eq", "n")]))


def set_size_report(records: DataFrame, group: str = GROUP) -> DataFrame:
    """Shares of each set size per group and pooled, with the size-0 rate by true label."""
    size, label = F.col("set_size"), F.col("label")
    right = (size == 1) & (((F.col("set_label") == "{anomalous}") & (label == 1))
                           | ((F.col("set_label") == "{normal}") & (label == 0)))

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    n = F.count(F.lit(1))
    return with_pooled(records.select(group, "set_size", "set_label", "label"), group).groupBy(
        "group").agg(
        n.alias("n"),
        ratio(count(size == 0), n).alias("frac_size0"),
        ratio(count(size == 1), n).alias("frac_size1"),
        ratio(count(size == 2), n).alias("frac_size2"),
        F.avg(size).alias("mean_set_size"),
        ratio(count(right), n).alias("frac_size1_correct"),
        ratio(count(right), count(size == 1)).alias("singleton_accuracy"),
        ratio(count((size == 0) & (label == 0)), count(label == 0))
        .alias("frac_size0_on_normal"),
        ratio(count((size == 0) & (label == 1)), count(label == 1))
        .alias("frac_size0_on_anomalous"))


def prediction_set_stage(test: DataFrame, normal_cal: DataFrame, synthetic: DataFrame,
                         delta: float = 0.05, **options) -> tuple[DataFrame, DataFrame]:
    """Sets calibrated with the synthetic anomalies only, and their size report."""
    anomalies = synthetic.where(F.col("synthetic_anomaly") == 1)
    out = prediction_sets(test, normal_cal, anomalies, delta, **options)
    return out, set_size_report(out)
