"""Group-wise (Mondrian) split-conformal calibration on normal-only data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.functions.columns import (INF, calibration_sd, check_delta, conformal_rank, finite,
                                      pvalue_uncertainty, uniform, widen)
from surety.plans.joins import attach_cells, attach_groups, bounded, require_none
from surety.plans.ranking import POOLED, order_statistics, ranked_cells, ranked_parts
from surety.plans.replicates import GOLD, mix, seeded, steps
from surety.plans.sketch import DRAW, draws, first_rows

SCORE, GROUP, ROW = "anomaly_score", "category", "image_id"


def calibration_pool(cal: DataFrame, score: str = SCORE, group: str = GROUP,
                     n_cal: int | None = None, seed: int = 0, row: str = ROW,
                     check: bool = True) -> DataFrame:
    """Finite scores of normal rows, optionally a seeded draw of ``n_cal`` rows per group.

    An anomalous row raises: calibration must not see anomalies.
    """
    if check and "label" in cal.columns:
        require_none(cal.where(F.col("label") != 0).select(group, "label"),
                     "conformal calibration must use normal-only data")
    pool = cal.where(finite(F.col(score)))
    if n_cal is not None:
        pool = first_rows(pool.withColumn("_u", uniform(seed, row)), [group], ["_u", row],
                          n_cal).drop("_u")
    return pool


def thresholds(pool: DataFrame, deltas: Sequence[float], score: str = SCORE,
               group: Sequence[str] = (GROUP,)) -> DataFrame:
    """``(group, delta, n_cal, threshold)`` for every delta from one ranking of the pool.

    The threshold is the ``ceil((n+1)(1-delta))``-th smallest score, and ``+inf`` when the
    pool is too small to certify that level.
    """
    check_delta(deltas)
    group = list(group)
    ranking = ranked_cells(pool, group, score, {"n": F.lit(1)})
    ranks = {f"t{i}": conformal_rank(F.col("n_total"), d) for i, d in enumerate(deltas)}
    wide = order_statistics(ranking, group, score, ranks)
    levels = F.explode(F.array(*[
        F.struct(F.lit(float(d)).alias("delta"),
                 F.coalesce(F.col(f"t{i}"), F.lit(INF)).alias("threshold"))
        for i, d in enumerate(deltas)]))
    return (wide.withColumn("_level", levels)
            .select(*group, "_level.delta", F.col("n_total").alias("n_cal"),
                    "_level.threshold"))


def pool_counts(test: DataFrame, pools: Mapping[str, DataFrame], score: str = SCORE,
                group: str = GROUP) -> DataFrame:
    """Attach, per pool, how many of its scores are at least / at most / equal to the row's.

    Adds ``<pool>_ge``, ``<pool>_le``, ``<pool>_eq`` and ``<pool>_n``. The pools and the test
    scores are collapsed together to distinct cells and counted by prefix sums; there is no
    inequality join. A missing score is above everything: nothing is at least or at most it.
    """
    names = list(pools)
    keyed = [test.select(group, score).withColumns({f"_{p}": F.lit(0) for p in names})]
    for name, pool in pools.items():
        keyed.append(pool.select(group, score).withColumns(
            {f"_{p}": F.lit(int(p == name)) for p in names}))
    union = keyed[0]
    for part in keyed[1:]:
        union = union.unionByName(part)
    ranking, parts = ranked_parts(union, [group], score,
                                  {"n": F.lit(1), **{p: F.col(f"_{p}") for p in names}})
    counted = ranking.select(
        group, score, "n",
        *[(F.col(f"{p}_total") - F.col(f"{p}_before")).alias(f"{p}_ge") for p in names],
        *[(F.col(f"{p}_before") + F.col(p)).alias(f"{p}_le") for p in names],
        *[F.col(p).alias(f"{p}_eq") for p in names])
    out = attach_cells(test, counted, parts, [group, score])
    sizes = parts.groupBy(group).agg(*[F.sum(p).alias(f"{p}_n") for p in names])
    out = attach_groups(out, sizes, [group])
    s = F.col(score)
    inside = finite(s)
    for p in names:
        n = F.coalesce(F.col(f"{p}_n"), F.lit(0))
        below, above = s == F.lit(-INF), s == F.lit(INF)
        out = out.withColumns({
            f"{p}_n": n,
            f"{p}_ge": F.when(inside, F.col(f"{p}_ge")).when(below, n).otherwise(F.lit(0)),
            f"{p}_le": F.when(inside, F.col(f"{p}_le")).when(above, n).otherwise(F.lit(0)),
            f"{p}_eq": F.when(inside, F.col(f"{p}_eq")).otherwise(F.lit(0)),
        })
    return out


def pvalue(at_least: Column, ties: Column, n: Column, u: Column | None = None) -> Column:
    """Conformal p-value from counts; with ``u`` the smoothed (tie-breaking) form.

    NULL when the pool is empty.
    """
    one = F.lit(1.0)
    top = one + at_least if u is None else one + (at_least - ties) + u * (one + ties)
    return F.when(n > 0, top / (n + one))


def conformal_pvalues(test: DataFrame, pool: DataFrame, score: str = SCORE, group: str = GROUP,
                      randomized: bool = False, seed: int = 0, row: str = ROW,
                      name: str = "conformal_p") -> DataFrame:
    """Attach ``(1 + #{pool >= s}) / (n + 1)`` per row, within its group."""
    counted = pool_counts(test, {"_cal": pool}, score, group)
    u = uniform(seed + 1, row) if randomized else None
    p = pvalue(F.col("_cal_ge"), F.col("_cal_eq"), F.col("_cal_n"), u)
    return counted.withColumn(name, p).drop("_cal_ge", "_cal_le", "_cal_eq", "_cal_n")


@dataclass
class MondrianConformal:
    """One calibrated threshold and p-value scale per group."""

    delta: float = 0.05
    randomized: bool = False
    seed: int = 0
    score: str = SCORE
    group: str = GROUP
    row: str = ROW
    pool: DataFrame | None = field(default=None, repr=False)
    fitted: DataFrame | None = field(default=None, repr=False)

    def fit(self, cal: DataFrame, n_cal: int | None = None,
            check: bool = True) -> MondrianConformal:
        """Keep the calibration pool and its ``(group, n_cal, threshold)`` table."""
        self.pool = calibration_pool(cal, self.score, self.group, n_cal, self.seed, self.row,
                                     check)
        self.fitted = bounded(
            thresholds(self.pool, [self.delta], self.score, [self.group]).drop("delta"))
        return self

    def transform(self, test: DataFrame, mode: str = "boundary", tau: float = 1.0,
                  strict: bool = True) -> DataFrame:
        """Attach ``conformal_p``, ``conformal_pred``, ``u_conformal`` and ``conformal_mode``.

        A row without a score is never flagged. ``strict`` raises when a test group has no
        calibration data.
        """
        if strict:
            require_none(test.select(self.group).distinct()
                         .join(self.fitted, self.group, "left_anti"),
                         "no calibration data for a test group")
        out = conformal_pvalues(test, self.pool, self.score, self.group, self.randomized,
                                self.seed, self.row)
        out = out.join(self.fitted, self.group, "left")
        s = F.col(self.score)
        flagged = s.isNotNull() & ~F.isnan(s) & (s > F.col("threshold"))
        return out.withColumns({
            "conformal_pred": F.coalesce(flagged, F.lit(False)).cast("int"),
            "u_conformal": pvalue_uncertainty(F.col("conformal_p"), mode, self.delta, tau),
            "conformal_mode": F.lit(mode),
        }).drop("threshold", "n_cal")


def calibrate(records: DataFrame, delta: float = 0.05, score: str = SCORE, group: str = GROUP,
              randomized: bool = False, seed: int = 0, n_cal: int | None = None,
              mode: str = "boundary", tau: float = 1.0,
              strict: bool = True) -> tuple[DataFrame, MondrianConformal]:
    """Calibrate on normal training rows and decide every test row.

    ``correct`` compares the decision with the label. A row without a score is never flagged, so
    it counts as the decision "normal" and is correct exactly when its label is 0.
    """
    cal = records.where((F.col("split") == "train") & (F.col("label") == 0))
    model = MondrianConformal(delta, randomized, seed, score, group).fit(cal, n_cal, check=False)
    if not model.fitted.limit(1).count():
        raise ValueError("no normal training records to calibrate on")
    out = model.transform(records.where(F.col("split") == "test"), mode, tau, strict)
    return out.withColumn("correct", F.col("conformal_pred") == F.col("label")), model


def uncertainty_modes(test: DataFrame, modes: Iterable[str], delta: float = 0.05,
                      tau: float = 1.0) -> DataFrame:
    """One ``u_conformal_<mode>`` column per mode, from the stored p-value."""
    if "conformal_p" not in test.columns:
        raise KeyError("conformal_p is missing; calibrate first")
    return test.withColumns({
        f"u_conformal_{m}": pvalue_uncertainty(F.col("conformal_p"), m, delta, tau)
        for m in modes})


def counts_at_most(rows: DataFrame, limits: DataFrame, score: str, group: str,
                   limit: str = "threshold") -> DataFrame:
    """For each limit row, ``n_at_most`` of the group's scores, and ``n_group`` in all.

    Rows and limits are ranked together, so many limits per group cost one pass over the rows
    rather than one copy of the rows per limit. Rows without a score are in ``n_group`` only.
    """
    finite_limits = limits.where(finite(F.col(limit)))
    union = rows.select(group, F.col(score).cast("double").alias("_v"),
                        F.lit(1).alias("_row")).unionByName(
        finite_limits.select(group, F.col(limit).alias("_v"), F.lit(0).alias("_row")))
    ranking = ranked_cells(union, [group], "_v", {"n": F.col("_row")})
    upto = ranking.select(group, F.col("_v").alias(limit),
                          (F.col("n_before") + F.col("n")).alias("n_at_most"))
    sizes = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_group"),
        F.count(F.when(finite(F.col(score)), 1)).alias("_n_scored"))
    out = limits.join(sizes, group, "right").join(upto, [group, limit], "left")
    return out.withColumn(
        "n_at_most",
        F.when(F.col(limit) == F.lit(INF), F.col("_n_scored"))
        .otherwise(F.coalesce(F.col("n_at_most"), F.lit(0)))).drop("_n_scored")


def binomial_draws(hits: int, total: int, n_boot: int, seed: int) -> np.ndarray:
    """Binomial(total, hits / total) counts by inversion of keyed uniform numbers.

    Probabilities are built outwards from the most likely count, as far as a double can tell from 0.
    """
    if hits in (0, total):
        return np.full(n_boot, hits)
    width = int(40 * np.sqrt(hits * (1 - hits / total)) + 40)
    low, high = max(hits - width, 0), min(hits + width, total)
    odds = hits / (total - hits)
    up = np.arange(hits, high)
    down = np.arange(hits, low, -1)
    log_p = np.concatenate([np.cumsum(np.log(down / (total - down + 1) / odds))[::-1], [0.0],
                            np.cumsum(np.log((total - up) / (up + 1) * odds))])
    table = np.cumsum(np.exp(log_p))
    with np.errstate(over="ignore"):
        bits = mix(seeded(hits + total * GOLD, seed) + steps(n_boot))
    u = (bits >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
    return low + np.searchsorted(table / table[-1], u, side="right")


def binomial_interval(n_boot: int, seed: int, alpha: float = 0.05):
    """Percentile-bootstrap interval of a share, as a pandas UDF over report rows.

    Resampling ``n`` zeros and ones with replacement draws a Binomial(n, share) count, so the
    replicates need only the two counts.
    """
    @F.pandas_udf("struct<lo: double, hi: double>")
    def interval(hits: pd.Series, total: pd.Series) -> pd.DataFrame:
        lows, highs = [], []
        for k, n in zip(hits, total):
            if n_boot <= 0 or not n:
                lows.append(None)
                highs.append(None)
                continue
            draws = binomial_draws(int(k), int(n), n_boot, seed) / n
            lows.append(float(np.quantile(draws, alpha / 2)))
            highs.append(float(np.quantile(draws, 1 - alpha / 2)))
        return pd.DataFrame({"lo": pd.Series(lows, dtype="float64"),
                             "hi": pd.Series(highs, dtype="float64")})
    return interval


def coverage_sweep(test: DataFrame, pool: DataFrame, deltas: Sequence[float],
                   score: str = SCORE, group: str = GROUP, n_boot: int = 1000,
                   seed: int = 0, calibration_term: bool = True) -> DataFrame:
    """Coverage on normal test rows per group and pooled, for every delta in one pass."""
    fitted = thresholds(pool, deltas, score, [group]).withColumnRenamed(group, "group")
    normals = (test.where(F.col("label") == 0)
               .select(F.col(group).cast("string").alias("group"), score))
    # Every (group, delta) pair appears, also for groups without calibration data.
    grid = (normals.select("group").distinct()
            .withColumn("delta", F.explode(F.array(*[F.lit(float(d)) for d in deltas]))))
    limits = bounded(grid.join(fitted, ["group", "delta"], "left"))
    sd = F.coalesce(*[F.when(F.col("delta") == F.lit(float(d)),
                             calibration_sd(F.col("n_cal"), d)) for d in deltas])
    per_group = (counts_at_most(normals, limits, score, "group")
                 .select("group", "delta", F.col("n_group").alias("n_normal_test"),
                         F.col("n_at_most").alias("_hits"),
                         F.coalesce("n_cal", F.lit(0)).alias("n_cal"),
                         sd.alias("calib_sd"), "threshold"))
    pools = (fitted.withColumn("calib_sd", sd).groupBy("delta").agg(
        F.sum("n_cal").alias("n_cal"),
        F.when(F.count("calib_sd") == F.count(F.lit(1)),
               F.avg("calib_sd") / F.sqrt(F.count(F.lit(1)))).alias("calib_sd")))
    pooled = (per_group.groupBy("delta").agg(F.sum("n_normal_test").alias("n_normal_test"),
                                             F.sum("_hits").alias("_hits"))
              .join(pools, "delta")    # one row per delta on both sides
              .select(F.lit(POOLED).alias("group"), "delta", "n_normal_test", "_hits", "n_cal",
                      "calib_sd", F.lit(None).cast("double").alias("threshold")))
    report = per_group.unionByName(pooled)
    empirical = F.col("_hits") / F.col("n_normal_test")
    report = report.withColumn("empirical_coverage", empirical).withColumn(
        "_ci", binomial_interval(n_boot, seed)("_hits", "n_normal_test")
        if n_boot > 0 else F.lit(None).cast("struct<lo: double, hi: double>"))
    sd_used = F.col("calib_sd") if calibration_term else F.lit(None).cast("double")
    return report.select(
        "group", "delta", "n_normal_test", (F.lit(1.0) - F.col("delta")).alias("nominal"),
        "empirical_coverage", F.col("_ci.lo").alias("ci_lo"), F.col("_ci.hi").alias("ci_hi"),
        F.col("n_cal").cast("bigint").alias("n_cal"), "calib_sd",
        widen(F.col("_ci.lo"), F.col("empirical_coverage"), sd_used, -1).alias("ci_lo_total"),
        widen(F.col("_ci.hi"), F.col("empirical_coverage"), sd_used, +1).alias("ci_hi_total"),
        "threshold")


def coverage_report(test: DataFrame, model: MondrianConformal, n_boot: int = 1000,
                    seed: int = 0, calibration_term: bool = True) -> DataFrame:
    """Empirical coverage of a fitted calibrator against its nominal level."""
    return coverage_sweep(test, model.pool, [model.delta], model.score, model.group, n_boot,
                          seed, calibration_term).drop("delta")


def n_cal_sensitivity(cal: DataFrame, test: DataFrame, deltas: Sequence[float] = (0.05,),
                      n_cals: Sequence[int | None] = (25, 50, 100, 200, None),
                      score: str = SCORE, group: str = GROUP, row: str = ROW, seed: int = 0,
                      n_repeats: int = 5) -> DataFrame:
    """Mean and spread of pooled coverage over repeated calibration draws of each size.

    The draws of all repeats are made in one pass over the pool and hold at most ``max(n_cals)``
    rows per group; a draw's prefixes serve the smaller sizes. All settings are scored against
    the test rows in one ranking.
    """
    pool = calibration_pool(cal, score, group)
    sizes = [n for n in n_cals if n is not None]
    limits = None
    if sizes:
        orders = [uniform(F.lit(seed) + F.lit(rep), row) for rep in range(n_repeats)]
        drawn = (draws(pool.select(group, score, row), [group], orders, row, max(sizes))
                 .withColumn("size", F.explode(F.array(*[F.lit(n) for n in sizes])))
                 .where(F.col(DRAW) <= F.col("size")))
        limits = thresholds(drawn, deltas, score, ["size", "rep", group])
    if None in list(n_cals):
        full = thresholds(pool, deltas, score, [group]).withColumns(
            {"size": F.lit(-1), "rep": F.lit(0)})
        limits = full if limits is None else limits.unionByName(full)
    normals = test.where(F.col("label") == 0).select(group, score)
    covered = counts_at_most(normals, bounded(limits), score, group)
    # Normal rows of groups without calibration data are not covered, but they count.
    pooled = (covered.where(F.col("delta").isNotNull()).groupBy("delta", "size", "rep")
              .agg((F.sum("n_at_most") / F.lit(normals.count())).alias("coverage")))
    return (pooled.groupBy("delta", F.col("size").cast("bigint").alias("n_cal"))
            .agg((F.lit(1.0) - F.max("delta")).alias("nominal"),
                 F.avg("coverage").alias("coverage_mean"),
                 F.stddev_pop("coverage").alias("coverage_std"),
                 F.count(F.lit(1)).alias("n_repeats")))


def shared_groups(rows: DataFrame, pool: DataFrame, group: str = GROUP) -> DataFrame:
    """Rows of the groups that ``pool`` has too."""
    return rows.join(bounded(pool.select(group).distinct()), group, "left_semi")


def cross_dataset_coverage(source_cal: DataFrame, source_test: DataFrame,
                           target_test: DataFrame, deltas: Sequence[float],
                           score: str = SCORE, group: str = GROUP, pool_groups: bool = False,
                           n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """Coverage of source thresholds on another dataset, per delta.

    Only target groups with source calibration data take part, unless ``pool_groups`` merges
    the calibration pool and the target into one group. The source test rows keep their groups,
    none of which has thresholds then, so the source coverage is zero.
    """
    if pool_groups:
        source_cal = source_cal.withColumn(group, F.lit("POOL"))
        target_test = target_test.withColumn(group, F.lit("POOL"))
    pool = calibration_pool(source_cal, score, group)
    shared = shared_groups(target_test, pool, group)
    if not shared.limit(1).count():
        raise ValueError("no target group shares a name with a source group; pool the groups")

    def pooled(test: DataFrame, side: str) -> DataFrame:
        report = coverage_sweep(test, pool, deltas, score, group, n_boot, seed)
        return report.where(F.col("group") == POOLED).select(
            "delta", "nominal", F.col("empirical_coverage").alias(f"{side}_coverage"),
            F.col("ci_lo").alias(f"{side}_ci_lo"), F.col("ci_hi").alias(f"{side}_ci_hi"))

    # One row per delta on each side.
    both = pooled(source_test, "source").join(
        pooled(shared, "target").drop("nominal"), "delta")
    return both.withColumns({
        "coverage_gap": F.col("source_coverage") - F.col("target_coverage"),
        "target_undercovers": F.col("target_ci_hi") < F.col("nominal")})
