"""Confidence intervals, DeLong comparison, multiplicity control, rank correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.functions.columns import INF, finite, two_sided_p
from surety.operators.metrics import class_sums, rank_metrics_of
from surety.plans.joins import attach_cells
from surety.plans.ranking import (average_rank, prefix_sums, ranked_cells, ranked_parts,
                                   with_pooled)
from surety.plans.replicates import with_weights
from surety.plans.resample import auroc_draws, percentile_interval, percentile_intervals
from surety.session import materialise


def bootstrap_auroc(df: DataFrame, group: Sequence[str], score: str = "anomaly_score",
                    label: str = "label", n_boot: int = 1000, seed: int = 0,
                    alpha: float = 0.05, with_ap: bool = False, stratified: bool = True) -> DataFrame:
    """Point value and percentile interval of AUROC (and AUPR) per group.

    Replicates draw as many rows of each class as there are; without ``stratified`` weights are Poisson.
    """
    if not group:
        return bootstrap_auroc(df.withColumn("_all", F.lit(0)), ["_all"], score, label, n_boot,
                               seed, alpha, with_ap, stratified).drop("_all")
    group = list(group)
    ranking, parts = ranked_parts(df, group, score, class_sums(F.col(label)), costly=True)
    out = rank_metrics_of(ranking, group)
    names = ["auroc", "aupr"] if with_ap else ["auroc"]
    draws = auroc_draws(parts, group, score, n_boot, seed, stratified, with_ap=with_ap, dealt=True)
    out = out.join(percentile_intervals(draws, group, names, alpha), group, "left")
    return out if with_ap else out.drop("aupr")


def align_scorers(a: DataFrame, b: DataFrame, row: str = "image_id",
                  keep: Sequence[str] = ("category", "label"),
                  score: str = "anomaly_score") -> DataFrame:
    """Rows both scorers have, with ``score_a`` and ``score_b``; an empty overlap raises."""
    # Stored, because the overlap is looked at here and read again by whoever asked for it.
    both = materialise(a.select(row, *keep, F.col(score).alias("score_a")).join(
        b.select(row, F.col(score).alias("score_b")), row))
    if not both.limit(1).count():
        raise ValueError("the two scorers share no rows")
    return both


def overlap_counts(a: DataFrame, b: DataFrame, row: str = "image_id") -> DataFrame:
    """Rows in each scorer and in both, to tell a partial overlap."""
    tagged = a.select(row, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(row, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    per_row = tagged.groupBy(row).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return per_row.agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"),
                       F.sum(F.col("_a") * F.col("_b")).alias("n_shared"))


def paired_bootstrap(aligned: DataFrame, group: Sequence[str], n_boot: int = 1000,
                     seed: int = 0, alpha: float = 0.05, row: str = "image_id",
                     label: str = "label", stratified: bool = True) -> DataFrame:
    """Interval and two-sided p-value of ``AUROC(a) - AUROC(b)`` on the same resamples.

    Rows are drawn before the scorers part, from all rows of a class, scored or not.
    """
    if not group:
        return paired_bootstrap(aligned.withColumn("_all", F.lit(0)), ["_all"], n_boot, seed,
                                alpha, row, label, stratified).drop("_all")
    group = list(group)
    weighted = materialise(with_weights(aligned.select(*group, row, label, "score_a", "score_b"), [*group, label], row, n_boot, seed, stratified))
    long = weighted.select(
        *group, row, label, "_w", F.explode(F.array(
            F.struct(F.lit("a").alias("scorer"), F.col("score_a").alias("score")),
            F.struct(F.lit("b").alias("scorer"), F.col("score_b").alias("score")))).alias("_s"))
    long = long.select(*group, row, label, "_w", "_s.scorer", "_s.score").where(finite(F.col("score")))
    keys = [*group, "scorer"]
    points = rank_metrics_of(ranked_cells(long, keys, "score", class_sums(F.col(label))), keys)

    def difference(df: DataFrame, by: list[str], name: str) -> DataFrame:
        side = {s: F.max(F.when(F.col("scorer") == s, F.col("auroc"))) for s in "ab"}
        return df.groupBy(*by).agg((side["a"] - side["b"]).alias(name))

    single = long.withColumns({"n": F.lit(1), "n_pos": F.col(label).cast("int")})
    draws = materialise(difference(
        auroc_draws(single, keys, "score", n_boot, seed, given=row), [*group, "rep"], "diff"))
    ends = percentile_interval(draws, group, "diff", alpha)
    sides = draws.where(F.col("diff").isNotNull()).groupBy(*group).agg(
        F.least(F.lit(1.0), F.lit(2.0) * F.least(
            F.avg((F.col("diff") <= 0).cast("int")),
            F.avg((F.col("diff") >= 0).cast("int")))).alias("p_value"))
    return (difference(points, group, "diff").join(ends, group, "left")
            .join(sides, group, "left"))


def delong(aligned: DataFrame, group: Sequence[str], label: str = "label") -> DataFrame:
    """DeLong's test for two correlated ROC curves, per group.

    A positive's component is the share of negatives it beats and a negative's the share of
    positives that beat it, ties counting half. Only the variance of the difference of the two
    scorers' components is needed.
    """
    group = list(group)
    base = aligned.where(finite(F.col("score_a")) & finite(F.col("score_b")))
    rows = base
    for side in "ab":
        score = f"score_{side}"
        # Both sides are ranked from the base rows, so no join is computed twice.
        ranking, parts = ranked_parts(base, group, score, class_sums(F.col(label)))
        neg, neg_total = F.col("n") - F.col("n_pos"), F.col("n_total") - F.col("n_pos_total")
        wins = (F.col("n_before") - F.col("n_pos_before") + neg / F.lit(2.0)) / neg_total
        losses = (F.lit(1.0) - (F.col("n_pos_before") + F.col("n_pos") / F.lit(2.0))
                  / F.col("n_pos_total"))
        placed = ranking.select(
            *group, score, "n",
            F.when(neg_total > 0, wins).alias(f"_win_{side}"),
            F.when(F.col("n_pos_total") > 0, losses).alias(f"_loss_{side}"))
        rows = attach_cells(rows, placed, parts, [*group, score])
        rows = rows.withColumn(f"v_{side}", F.when(F.col(label) == 1, F.col(f"_win_{side}"))
                               .otherwise(F.col(f"_loss_{side}"))).drop(
            f"_win_{side}", f"_loss_{side}")
    d = F.col("v_a") - F.col("v_b")
    pos = F.col(label) == 1
    stats = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(pos, 1)).alias("_m"),
        F.avg(F.when(pos, F.col("v_a"))).alias("auc_a"),
        F.avg(F.when(pos, F.col("v_b"))).alias("auc_b"),
        F.var_samp(F.when(pos, d)).alias("_vp"), F.var_samp(F.when(~pos, d)).alias("_vn"))
    m, k = F.col("_m"), F.col("n") - F.col("_m")
    both = (m > 0) & (k > 0)
    variance = F.col("_vp") / m + F.col("_vn") / k
    delta = F.col("auc_a") - F.col("auc_b")
    z = (F.when(variance > 0, delta / F.sqrt(variance))
         .when(variance.isNotNull(), F.when(delta == 0, F.lit(0.0)).otherwise(F.lit(INF))))
    return (stats.withColumns({"delta": F.when(both, delta), "z": F.when(both, z)})
            .select(*group, F.when(both, F.col("auc_a")).alias("auc_a"),
                    F.when(both, F.col("auc_b")).alias("auc_b"), "delta", "z",
                    two_sided_p("z").alias("p_value"), "n"))


def holm(df: DataFrame, p: str, row: str, alpha: float = 0.05,
         name: str = "significant_holm") -> DataFrame:
    """Step-down Holm-Bonferroni: reject up to the first p-value above its level.

    A missing p-value counts as 1.
    """
    ranks = prefix_sums(df.select(row, F.coalesce(F.when(~F.isnan(p), F.col(p)), F.lit(1.0))
                                  .alias("_p"), F.lit(1).alias("n")), [], ["_p", row], ["n"])
    level = F.lit(alpha) / (F.col("n_total") - F.col("n_before"))
    ranks = materialise(ranks.select(row, F.col("n_before").alias("_rank"),
                                     (F.col("_p") > level).alias("_stop")))
    first = ranks.agg(F.min(F.when(F.col("_stop"), F.col("_rank")))).first()[0]
    kept = F.lit(True) if first is None else F.col("_rank") < first
    return df.join(ranks.select(row, kept.alias(name)), row)


def scorer_comparison(a: DataFrame, b: DataFrame, name_a: str, name_b: str,
                      group: str = "category", row: str = "image_id",
                      alpha: float = 0.05) -> DataFrame:
    """DeLong per group and pooled on the shared rows, Holm-corrected over the whole table."""
    aligned = with_pooled(align_scorers(a, b, row, (group, "label")), group)
    table = materialise(delong(aligned, ["group"]))
    table = holm(table, "p_value", "group", alpha)
    return table.withColumns({"scorer_a": F.lit(name_a), "scorer_b": F.lit(name_b)})


def spearman(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Spearman's rho on pairs where both values are finite.

    NULL with fewer than three pairs or when either side is constant.
    """
    group = list(group)
    base = df.where(finite(F.col(x)) & finite(F.col(y)))
    rows = base
    for column, rank in ((x, "_rx"), (y, "_ry")):
        ranking, parts = ranked_parts(base, group, column, {"n": F.lit(1)})
        ranks = ranking.select(*group, column, "n", average_rank().alias(rank))
        rows = attach_cells(rows, ranks, parts, [*group, column])
    stats = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(
            F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry")).alias("_r"),
        (F.min("_rx") < F.max("_rx")).alias("_dx"), (F.min("_ry") < F.max("_ry")).alias("_dy"))
    known = (F.col("n") >= 3) & F.col("_dx") & F.col("_dy")
    return stats.select(*group, "n", F.when(known, F.col("_r")).alias("rho"))

