"""Outcome labels, case browsing and the count tables of the early notebook analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.functions.columns import finite
from surety.operators.metrics import auroc
from surety.plans.joins import attach_groups
from surety.plans.ranking import quantiles, ranked_cells

OUTCOMES = ["TP", "TN", "FP", "FN"]
INFO_FIELDS = ["image_id", "category", "defect_type", "label", "anomaly_score", "conformal_pred",
               "prediction_type", "predicted_defect", "predicted_location", "observation"]


def _outcome(label: Column, pred: Column) -> Column:
    return (F.when((label == 1) & (pred == 1), "TP").when((label == 0) & (pred == 0), "TN")
            .when((label == 1) & (pred == 0), "FN").when((label == 0) & (pred == 1), "FP")
            .otherwise("Unknown"))


def prediction_type(df: DataFrame, prediction: str = "conformal_pred") -> DataFrame:
    """Attach TP/TN/FN/FP from a calibrated decision; a missing column raises."""
    if prediction not in df.columns:
        raise KeyError(f"{prediction!r} not found; calibrate first")
    return df.withColumn("prediction_type", _outcome(F.col("label"), F.col(prediction)))


def select_cases(df: DataFrame, category: str | None = None, defect_type: str | None = None,
                 filter_query: str | None = None, sort_by: str | None = None,
                 ascending: bool = True, n: int = 6, row: str = "image_id") -> DataFrame:
    """The first ``n`` rows that match; ties in the sort are ordered by ``row``."""
    if category is not None:
        df = df.where(F.col("category") == category)
    if defect_type is not None:
        df = df.where(F.col("defect_type") == defect_type)
    if filter_query:
        df = df.where(F.expr(filter_query))
    if sort_by:
        key = F.col(sort_by)
        df = df.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_last(), row)
    else:
        df = df.orderBy(row)
    fields = [c for c in INFO_FIELDS if c in df.columns]
    return df.limit(n).select(*fields, *[c for c in df.columns
                                         if c.startswith("u_") and c not in fields])


def median_decision(df: DataFrame, group: str = "category", score: str = "anomaly_score",
                    name: str = "prediction") -> DataFrame:
    """Flag the rows above their group's median score."""
    ranking = ranked_cells(df, [group], score, {"n": F.lit(1)})
    medians = quantiles(ranking, [group], score, {"median": 0.5}).select(group, "median")
    return attach_groups(df, medians, [group]).withColumn(
        name, F.coalesce((F.col(score) > F.col("median")) & ~F.isnan(score), F.lit(False))
        .cast("int"))


def exact_outcome(df: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Outcome of unanimous votes only: a score of exactly 0 or 1."""
    s = F.col(score)
    pred = F.when(s == 1, 1).when(s == 0, 0)
    return df.withColumn("prediction_type", F.coalesce(_outcome(F.col("label"), pred),
                                                       F.lit("Unknown")))


def outcome_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("prediction_type").agg(F.count(F.lit(1)).alias("count"))


def outcome_pivot(df: DataFrame, group: str = "category") -> DataFrame:
    """Outcome counts per group with the accuracy in percent."""
    wide = (df.groupBy(group).pivot("prediction_type", [*OUTCOMES, "Unknown"]).count()
            .na.fill(0))
    right, wrong = F.col("TP") + F.col("TN"), F.col("FP") + F.col("FN")
    return wide.select(group, *OUTCOMES, "Unknown", right.alias("Correct"),
                       wrong.alias("Wrong"), F.when(right + wrong > 0, F.bround(
                           F.lit(100.0) * right / (right + wrong), 2)).alias("Accuracy (%)"))


def error_pivot(df: DataFrame) -> DataFrame:
    """False positives and negatives per group and defect type."""
    errors = df.where(F.col("prediction_type").isin("FP", "FN"))
    return (errors.groupBy("category", "defect_type").pivot("prediction_type", ["FP", "FN"])
            .count().na.fill(0))


def group_summary(df: DataFrame, signals: Sequence[str], prediction: Column | None = None,
                  group: str = "category", drop_single_class: bool = False,
                  digits: int | None = 4) -> DataFrame:
    """AUROC per group and each signal's mean on right and wrong decisions.

    The decision is the group median split unless ``prediction`` is given.
    """
    if prediction is None:
        df = median_decision(df, group, name="_pred")
    else:
        df = df.withColumn("_pred", prediction.cast("int"))
    right = F.col("_pred") == F.col("label")

    def shown(c: Column) -> Column:
        return c if digits is None else F.round(c, digits)

    means = []
    for s in signals:
        value = F.when(finite(F.col(s)), F.col(s))
        means += [shown(F.avg(F.when(right, value))).alias(f"{s}_correct"),
                  shown(F.avg(F.when(~right, value))).alias(f"{s}_wrong")]
    table = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_images"),
                                  F.countDistinct("label").alias("_classes"), *means)
    out = table.join(auroc(df, [group]).select(group, shown(F.col("auroc")).alias("AUROC")),
                     group, "left")
    if drop_single_class:
        out = out.where(F.col("_classes") > 1)
    return out.drop("_classes")


def overall_auroc(summary: DataFrame) -> DataFrame:
    """Mean AUROC over the groups of a summary."""
    return summary.agg(F.avg("AUROC").alias("overall_mean_auroc"))
