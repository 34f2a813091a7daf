"""Evaluation under distribution shift, against calibration on clean data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surety.functions.columns import finite
from surety.operators.conformal import MondrianConformal
from surety.operators.inference import bootstrap_auroc, spearman
from surety.operators.metrics import auroc
from surety.operators.selective import area_summary, risk_coverage, signals_long
from surety.session import materialise

CELL = ["corruption", "severity"]


def calibrate_cells(clean_cal: DataFrame, cells: DataFrame, delta: float = 0.05,
                    **options) -> DataFrame:
    """Decide the rows of every ``(corruption, severity)`` cell with clean thresholds."""
    model = MondrianConformal(delta=delta, **options).fit(clean_cal)
    out = model.transform(cells)
    return out.withColumn("correct", F.col("conformal_pred") == F.col("label"))


def evaluate_cells(rows: DataFrame, signals: Sequence[str], n_boot: int = 0, seed: int = 0,
                   row: str = "image_id") -> DataFrame:
    """One row per cell: detection, accuracy, coverage, and each signal's mean and AURC."""
    sizes = ["set_size"] if "set_size" in rows.columns else []
    # Three aggregations read these columns; deriving them once is cheaper.
    rows = materialise(rows.select(*CELL, row, "label", "anomaly_score", "conformal_pred",
                                   "correct", *signals, *sizes))
    s = F.col("anomaly_score")
    normal = F.col("label") == 0
    kept = finite(s) & (F.col("conformal_pred") == 0)
    columns = [F.count(F.lit(1)).alias("n"),
               F.avg(F.col("correct").cast("int")).alias("accuracy"),
               F.avg(F.when(normal, kept.cast("int"))).alias("coverage_on_normals")]
    columns += [F.avg(F.when(finite(F.col(u)), F.col(u))).alias(f"mean_{u}") for u in signals]
    if "set_size" in rows.columns:
        size = F.col("set_size")
        columns += [F.avg((size == k).cast("int")).alias(f"frac_set_size{k}") for k in range(3)]
        columns.append(F.avg(size).alias("mean_set_size"))
    out = rows.groupBy(*CELL).agg(*columns)
    if n_boot > 0:
        points = bootstrap_auroc(rows, CELL, n_boot=n_boot, seed=seed)
    else:
        none = F.lit(None).cast("double")
        points = auroc(rows, CELL).withColumns({"auroc_ci_lo": none, "auroc_ci_hi": none})
    out = out.join(points.drop("n", "n_pos"), CELL, "left")
    long = signals_long(rows, [*CELL, row, "correct"], signals)
    curve = risk_coverage(long, [*CELL, "signal"], "value", "correct", row, named=False)
    areas = (area_summary(curve, [*CELL, "signal"]).groupBy(*CELL)
             .pivot("signal", list(signals)).agg(F.max("aurc")))
    for u in signals:
        areas = areas.withColumnRenamed(u, f"aurc_{u}")
    return out.join(areas, CELL, "left")


def with_clean_row(sweep: DataFrame, clean: str = "none") -> DataFrame:
    """Each corruption's rows with the clean row put before them at severity 0."""
    shifted = sweep.where(F.col("corruption") != clean)
    base = (shifted.select("corruption").distinct().withColumn("_clean", F.lit(clean)).join(
        sweep.where(F.col("corruption") == clean).withColumnRenamed("corruption", "_clean"),
        "_clean").withColumn("severity", F.lit(0).cast("bigint")).drop("_clean"))
    return base.unionByName(shifted)


def silent_failure(delta_auroc: Column, rho: Column) -> Column:
    """Detection fell while the signal did not clearly rise.

    An undefined correlation is a signal that did not move, so it counts as silent.
    """
    return F.coalesce(delta_auroc < -0.02, F.lit(False)) & (rho.isNull() | (rho < 0.5))


def monotonicity(sweep: DataFrame, signals: Sequence[str],
                 extra: Sequence[str] = ()) -> DataFrame:
    """Does each signal rise with severity while detection falls?

    ``signals`` are tracked through their ``mean_`` columns and ``extra`` columns as they are.
    """
    full = with_clean_row(materialise(sweep)).withColumn("severity", F.col("severity").cast("double"))
    tracked = {s: F.col(f"mean_{s}") for s in signals} | {c: F.col(c) for c in extra}
    long = full.select("corruption", "severity", "auroc", F.explode(F.array(*[
        F.struct(F.lit(n).alias("signal"), c.cast("double").alias("value"))
        for n, c in tracked.items()])).alias("_t")).select(
        "corruption", "severity", "auroc", "_t.signal", "_t.value")
    keys = ["corruption", "signal"]
    rho_u = spearman(long, keys, "severity", "value").select(
        *keys, F.col("rho").alias("spearman_severity_vs_uncertainty"))
    rho_a = spearman(long, keys, "severity", "auroc").select(
        *keys, F.col("rho").alias("spearman_severity_vs_auroc"))

    def change(c: str) -> Column:
        return F.max_by(c, "severity") - F.min_by(c, "severity")

    ends = long.groupBy(*keys).agg(change("auroc").alias("delta_auroc_at_s5"),
                                   change("value").alias("delta_uncertainty_at_s5"))
    out = ends.join(rho_u, keys, "left").join(rho_a, keys, "left")
    rho = F.col("spearman_severity_vs_uncertainty")
    return out.withColumns({"rho_undefined": rho.isNull(),
                            "silent_failure": silent_failure(F.col("delta_auroc_at_s5"), rho)})


def scaled_curves(sweep: DataFrame, signals: Sequence[str], clean: str = "none") -> DataFrame:
    """Mean over corruptions per severity, min-max scaled per signal, for plotting."""
    means = sweep.where(F.col("corruption") != clean).groupBy("severity").agg(
        *[F.avg(f"mean_{s}").alias(s) for s in signals])
    long = means.unpivot(["severity"], list(signals), "signal", "value")
    whole = Window.partitionBy("signal")    # one row per severity
    lo, hi = F.min("value").over(whole), F.max("value").over(whole)
    return long.withColumn("scaled", F.when(
        hi - lo > 1e-12, (F.col("value") - lo) / (hi - lo)).otherwise(F.lit(0.0)))
