"""Risk-coverage curves: what is gained by rejecting the most uncertain rows first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.functions.columns import INF, finite
from surety.plans.ranking import prefix_sums

COVERAGES = (0.5, 0.7, 0.8, 0.9, 1.0)
RISKS = (0.05, 0.10, 0.20)


def risk_coverage(df: DataFrame, group: Sequence[str], uncertainty: str,
                  correct: str = "correct", row: str = "image_id",
                  abstain: Column | None = None, abstain_as_error: bool = False,
                  named: bool = True) -> DataFrame:
    """One row per kept prefix: ``k``, ``coverage``, ``risk``, with ``n`` and ``n_errors``.

    The most certain rows are kept first. Missing uncertainty and abstentions go last, and
    ties are ordered by ``row``. An abstention keeps its own correctness unless
    ``abstain_as_error`` is set. Without ``named`` rows only serve the order and the curve has no ``row``.
    """
    group = list(group)
    abstain = F.lit(False) if abstain is None else F.coalesce(abstain, F.lit(True))
    wrong = 1 - F.col(correct).cast("int")
    if abstain_as_error:
        wrong = F.when(abstain, F.lit(1)).otherwise(wrong)
    u = F.col(uncertainty).cast("double")
    keep = F.when(finite(u) & ~abstain, u).otherwise(F.lit(INF))
    rows = df.select(*group, row, keep.alias("_u"), wrong.alias("err"), F.lit(1).alias("n"))
    ordered = prefix_sums(rows, group, ["_u", row], ["n", "err"], keep_order=named)
    k = F.col("n_before") + 1
    return ordered.select(
        *group, *([row] if named else []), k.alias("k"), (k / F.col("n_total")).alias("coverage"),
        ((F.col("err_before") + F.col("err")) / k).alias("risk"),
        F.col("n_total").alias("n"), F.col("err_total").alias("n_errors"))


def oracle_risk() -> Column:
    """Risk at ``k`` when every error is rejected first."""
    right = F.col("n") - F.col("n_errors")
    return F.greatest(F.col("k") - right, F.lit(0)) / F.col("k")


def coverage_at_risk(target: float) -> Column:
    return F.coalesce(F.max(F.when(F.col("risk") <= target, F.col("coverage"))), F.lit(0.0))


def risk_at_coverage(target: float) -> Column:
    reached = F.col("coverage") >= target
    return F.min_by(F.when(reached, F.col("risk")), F.when(reached, F.col("k")))


def area_summary(curve: DataFrame, group: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """AURC, excess AURC over the oracle order, and the row count."""
    return curve.groupBy(*group).agg(
        F.avg("risk").alias("aurc"), (F.avg("risk") - F.avg(oracle_risk())).alias("eaurc"),
        F.max("n").alias("n"), *extra)


def signals_long(records: DataFrame, keys: Sequence[str], signals: Sequence[str]) -> DataFrame:
    """``keys`` plus one ``(signal, value)`` row per signal."""
    wide = records.select(*keys, *[F.col(s).cast("double").alias(s) for s in signals])
    return wide.unpivot(list(keys), list(signals), "signal", "value")


def selective_table(records: DataFrame, signals: Sequence[str], correct: str = "correct",
                    row: str = "image_id", coverages: Sequence[float] = COVERAGES,
                    risks: Sequence[float] = RISKS, by: Sequence[str] = (),
                    abstain_as_error: bool = False) -> DataFrame:
    """AURC, eAURC, accuracy at fixed coverage and coverage at fixed risk per signal."""
    by = list(by)
    has_parse = "parse_ok" in records.columns
    keys = [*by, row, correct] + (["parse_ok"] if has_parse else [])
    long = signals_long(records, keys, signals)
    curve = risk_coverage(long, [*by, "signal"], "value", correct, row,
                          ~F.col("parse_ok") if has_parse else None, abstain_as_error, named=False)
    extra = [(F.lit(1.0) - risk_at_coverage(c)).alias(f"acc@cov{c:g}") for c in coverages]
    extra += [coverage_at_risk(r).alias(f"cov@risk{r:g}") for r in risks]
    return area_summary(curve, [*by, "signal"], extra).orderBy("aurc", "signal")


def accuracy_at_coverage(curve: DataFrame, group: Sequence[str], coverage: float) -> DataFrame:
    return curve.groupBy(*group).agg(
        (F.lit(1.0) - risk_at_coverage(coverage)).alias("accuracy"))
