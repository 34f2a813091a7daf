"""Detection and calibration metrics, computed from ranked score cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.functions.columns import clip, ratio
from surety.plans.joins import attach_groups
from surety.plans.ranking import (POOLED, cells, quantiles, ranked_cells, ranked_parts,
                                   with_pooled)
from surety.plans.resample import auroc_draws, percentile_interval, percentile_intervals
from surety.session import materialise

SCORE, LABEL = "anomaly_score", "label"


def class_sums(label: Column) -> dict[str, Column]:
    return {"n": F.lit(1), "n_pos": label.cast("int")}


def rank_metrics(df: DataFrame, group: Sequence[str], score: str = SCORE,
                 label: str = LABEL) -> DataFrame:
    """AUROC and average precision per group; NULL where only one class is present.

    AUROC is the Mann-Whitney statistic with ties counted half; average precision is the step
    sum over distinct thresholds. Rows without a finite score are left out.
    """
    ranking = ranked_cells(df, group, score, class_sums(F.col(label)))
    return rank_metrics_of(ranking, group)


def rank_metrics_of(ranking: DataFrame, group: Sequence[str]) -> DataFrame:
    n, pos = F.col("n"), F.col("n_pos")
    neg_before = F.col("n_before") - F.col("n_pos_before")
    hits = F.col("n_pos_total") - F.col("n_pos_before")
    flagged = F.col("n_total") - F.col("n_before")
    stats = ranking.groupBy(*group).agg(
        F.max("n_total").alias("n"), F.max("n_pos_total").alias("n_pos"),
        F.sum(pos * (neg_before + (n - pos) / F.lit(2.0))).alias("_u"),
        F.sum(pos * hits / flagged).alias("_ap"))
    n, pos = F.col("n"), F.col("n_pos")
    both = (pos > 0) & (n > pos)
    return stats.select(*group, "n", "n_pos",
                        F.when(both, F.col("_u") / (pos * (n - pos))).alias("auroc"),
                        F.when(both, F.col("_ap") / pos).alias("aupr"))


def auroc(df: DataFrame, group: Sequence[str], score: str = SCORE,
          label: str = LABEL) -> DataFrame:
    return rank_metrics(df, group, score, label).drop("aupr")


def average_precision(df: DataFrame, group: Sequence[str], score: str = SCORE,
                      label: str = LABEL) -> DataFrame:
    return rank_metrics(df, group, score, label).drop("auroc")


def error_auroc(df: DataFrame, group: Sequence[str], uncertainty: str,
                correct: str = "correct") -> DataFrame:
    """How well a signal ranks wrong decisions above right ones."""
    wrong = df.withColumn("_wrong", (~F.col(correct).cast("boolean")).cast("int"))
    return auroc(wrong, group, uncertainty, "_wrong")


def _score_cells(df: DataFrame, group: Sequence[str], score: str, label: str) -> DataFrame:
    return cells(df, group, score, class_sums(F.col(label)))


def _brier(score: str) -> Column:
    p, pos = F.col(score), F.col("n_pos")
    miss = F.lit(1.0) - p
    return pos * miss * miss + (F.col("n") - pos) * p * p


def _nll(score: str) -> Column:
    p, pos = clip(F.col(score), 1e-12, 1.0 - 1e-12), F.col("n_pos")
    return -(pos * F.log(p) + (F.col("n") - pos) * F.log(F.lit(1.0) - p))


def brier(df: DataFrame, group: Sequence[str], score: str = SCORE,
          label: str = LABEL) -> DataFrame:
    """Mean squared error of the score as a probability."""
    return _score_cells(df, group, score, label).groupBy(*group).agg(
        (F.sum(_brier(score)) / F.sum("n")).alias("brier"))


def nll(df: DataFrame, group: Sequence[str], score: str = SCORE,
        label: str = LABEL) -> DataFrame:
    """Mean negative log-likelihood."""
    return _score_cells(df, group, score, label).groupBy(*group).agg(
        (F.sum(_nll(score)) / F.sum("n")).alias("nll"))


def _bins(values: DataFrame, group: Sequence[str], score: str, n_bins: int,
          ranking: DataFrame | None) -> DataFrame:
    """Sums per ``(group, bin)`` of distinct ``values``: rows, positives and score total.

    With a ``ranking`` the edges are exact quantiles with duplicates removed; the last edge
    belongs to the last bin.
    """
    probabilities = [i / n_bins for i in range(n_bins + 1)]
    if ranking is not None:
        edges = quantiles(ranking, group, score,
                          {f"_e{i}": q for i, q in enumerate(probabilities)})
        edges = edges.select(*group, F.array_distinct(F.array(
            *[F.col(f"_e{i}") for i in range(n_bins + 1)])).alias("_edges"))
        binned = attach_groups(values, edges, group, "inner")
    else:
        binned = values.withColumn("_edges", F.array(*[F.lit(q) for q in probabilities]))
    p = F.col(score)
    place = F.size(F.filter("_edges", lambda e: e <= p)) - 1
    last = F.greatest(F.size("_edges") - 2, F.lit(0))
    return (binned.withColumn("bin", F.greatest(F.least(place, last), F.lit(0)))
            .groupBy(*group, "bin")
            .agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"),
                 F.sum(p * F.col("n")).alias("_p")))


def _binned(df: DataFrame, group: Sequence[str], score: str, label: str, n_bins: int,
            adaptive: bool) -> DataFrame:
    """Bins of a frame; only adaptive edges need the values in order."""
    if not adaptive:
        return _bins(_score_cells(df, group, score, label), group, score, n_bins, None)
    ranking, parts = ranked_parts(df, group, score, class_sums(F.col(label)))
    return _bins(parts, group, score, n_bins, ranking)


def reliability_curve(df: DataFrame, group: Sequence[str], n_bins: int = 15,
                      adaptive: bool = True, score: str = SCORE,
                      label: str = LABEL) -> DataFrame:
    """Mean score, empirical frequency and row count of every non-empty bin."""
    return _binned(df, group, score, label, n_bins, adaptive).select(
        *group, "bin", (F.col("_p") / F.col("n")).alias("mean_predicted"),
        (F.col("n_pos") / F.col("n")).alias("empirical_frequency"), F.col("n").alias("bin_count"))


def _bin_errors(bins: DataFrame, group: Sequence[str], suffix: str, min_bin: int) -> DataFrame:
    gap = F.abs(F.col("n_pos") / F.col("n") - F.col("_p") / F.col("n"))
    return bins.groupBy(*group).agg(
        (F.sum(F.col("n") * gap) / F.sum("n")).alias(f"ece_{suffix}"),
        F.max(F.when(F.col("n") >= min_bin, gap)).alias(f"mce_{suffix}"))


def calibration_errors(df: DataFrame, group: Sequence[str], n_bins: int = 15,
                       adaptive: bool = True, min_bin: int = 5, score: str = SCORE,
                       label: str = LABEL) -> DataFrame:
    """Expected and maximum calibration error per group.

    With all scores equal there is one bin, whose gap is ``|mean label - mean score|``.
    """
    name = "adaptive" if adaptive else "equalwidth"
    return _bin_errors(_binned(df, group, score, label, n_bins, adaptive), group, name, min_bin)


def calibration_table(records: DataFrame, n_bins: int = 15, group: str = "category",
                      score: str = SCORE, label: str = LABEL) -> DataFrame:
    """ECE (adaptive and equal-width), MCE, Brier and NLL per group and pooled."""
    fanned = with_pooled(records.select(group, score, label), group)
    rows = fanned.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    # Only the adaptive edges need the order; all else reads the stored distinct scores.
    ranking, parts = ranked_parts(fanned, ["group"], score, class_sums(F.col(label)))
    adaptive = _bin_errors(_bins(parts, ["group"], score, n_bins, ranking), ["group"],
                           "adaptive", 5)
    equal = _bin_errors(_bins(parts, ["group"], score, n_bins, None), ["group"],
                        "equalwidth", 5).drop("mce_equalwidth")
    proper = parts.groupBy("group").agg(
        (F.sum(_brier(score)) / F.sum("n")).alias("brier"),
        (F.sum(_nll(score)) / F.sum("n")).alias("nll"))
    return (rows.join(adaptive, "group", "left").join(equal, "group", "left")
            .join(proper, "group", "left")
            .select("group", "n", "ece_adaptive", "ece_equalwidth",
                    F.col("mce_adaptive").alias("mce"), "brier", "nll"))


def detection_table(records: DataFrame, n_boot: int = 1000, seed: int = 0,
                    group: str = "category", score: str = SCORE,
                    label: str = LABEL) -> DataFrame:
    """AUROC and AUPR with bootstrap intervals per group and pooled, plus the group mean."""
    fanned = with_pooled(records.select(group, score, label), group)
    rows = fanned.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col(label) == 1, 1)).alias("n_anomalous"))
    ranking, parts = ranked_parts(fanned, ["group"], score, class_sums(F.col(label)), costly=n_boot > 0)
    table = rows.join(rank_metrics_of(ranking, ["group"]).drop("n", "n_pos"), "group", "left")
    table = _with_intervals(table, parts, ["group"], score, ["auroc", "aupr"], n_boot, seed)
    columns = ["group", "n", "n_anomalous", "auroc", "auroc_ci_lo", "auroc_ci_hi",
               "aupr", "aupr_ci_lo", "aupr_ci_hi"]
    none = F.lit(None).cast("double")
    mean = table.where(F.col("group") != POOLED).agg(
        F.sum("n").alias("n"), F.sum("n_anomalous").alias("n_anomalous"),
        F.avg("auroc").alias("auroc"), F.avg("aupr").alias("aupr")).withColumns({
            "group": F.lit("MEAN_OF_CATEGORIES"), "auroc_ci_lo": none, "auroc_ci_hi": none,
            "aupr_ci_lo": none, "aupr_ci_hi": none})
    return table.select(*columns).unionByName(mean.select(*columns))


def cross_dataset_detection(source: DataFrame, target: DataFrame, n_boot: int = 1000,
                            seed: int = 0, group: str = "category", score: str = SCORE,
                            label: str = LABEL) -> DataFrame:
    """AUROC and AUPR on two datasets per group and pooled, and target minus source.

    Both datasets are ranked in one pass. Their resamples are independent of each other, and the
    interval of a difference holds the differences replicate by replicate. A group that one
    dataset lacks, or in which it has one class only, has NULL there and in the differences.
    """
    keys, both = ["side", "group"], ["auroc", "aupr"]
    rows = source.select(group, score, label).withColumn("side", F.lit("source")).unionByName(
        target.select(group, score, label).withColumn("side", F.lit("target")))
    fanned = with_pooled(rows, group)
    counts = fanned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col(label) == 1, 1)).alias("n_anomalous"))
    ranking, parts = ranked_parts(fanned, keys, score, class_sums(F.col(label)), costly=n_boot > 0)
    table = counts.join(rank_metrics_of(ranking, keys).drop("n", "n_pos"), keys, "left")
    ends = [f"{m}_ci_{end}" for m in both for end in ("lo", "hi")]
    if n_boot > 0:
        # Few rows, which are read for either side and for the differences.
        draws = materialise(auroc_draws(parts, keys, score, n_boot, seed, with_ap=True, dealt=True))
        for m in both:
            table = table.join(percentile_interval(draws, keys, m), keys, "left")
    else:
        table = table.withColumns({end: F.lit(None).cast("double") for end in ends})

    def of_sides(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
        wide = df.groupBy(*by).agg(*[
            F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}")
            for side in ("source", "target") for c in names])
        return wide.withColumns({f"delta_{m}": F.col(f"target_{m}") - F.col(f"source_{m}") for m in both})

    out = of_sides(table, ["group"], ["n", "n_anomalous", *both, *ends])
    if n_boot > 0:
        changes = of_sides(draws, ["group", "rep"], both)
        for m in both:
            out = out.join(percentile_interval(changes, ["group"], f"delta_{m}"), "group", "left")
        return out
    return out.withColumns({f"delta_{end}": F.lit(None).cast("double") for end in ends})


def _with_intervals(table: DataFrame, parts: DataFrame, group: list[str], value: str,
                    names: list[str], n_boot: int, seed: int) -> DataFrame:
    """Attach ``<name>_ci_lo/hi``; NULL when ``n_boot`` is 0."""
    if n_boot <= 0:
        return table.withColumns({f"{m}_ci_{end}": F.lit(None).cast("double")
                                  for m in names for end in ("lo", "hi")})
    draws = auroc_draws(parts, group, value, n_boot, seed, with_ap="aupr" in names, dealt=True)
    return table.join(percentile_intervals(draws, group, names), group, "left")


def abstention_summary(records: DataFrame, group: str = "category") -> DataFrame:
    """Abstentions and answered rows per group and pooled."""
    parsed = F.col("parse_ok")
    out = with_pooled(records.select(group, "parse_ok"), group).groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~parsed, 1)).alias("n_abstain"),
        F.count(F.when(parsed, 1)).alias("n_answered"))
    return out.select(F.col("group").alias("category"), "n", "n_abstain",
                      ratio(F.col("n_abstain"), F.col("n")).alias("abstention_rate"),
                      "n_answered")


def error_prediction_table(records: DataFrame, signals: Sequence[str],
                           correct: str = "correct", n_boot: int = 1000, seed: int = 0,
                           group: str = "category", prediction: str = "conformal_pred",
                           score: str = SCORE, by: Sequence[str] = ()) -> DataFrame:
    """AUROC of each signal for predicting a wrong decision, with two controls.

    Score-monotone baselines show what any function of the score gets for free, and the
    ``pred=`` scopes repeat the test inside each decision. Scopes other than ``POOLED`` with
    one outcome only are left out. ``by`` adds leading key columns (for example the halves of
    a split), all computed in the same pass.
    """
    if not signals:
        raise ValueError("no uncertainty signals given")
    by = list(by)
    names = list(signals)
    values = [F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value"))
              for s in names]
    if score in records.columns:
        s = F.col(score).cast("double")
        values += [F.struct(F.lit("BASELINE:score").alias("signal"), s.alias("value")),
                   F.struct(F.lit("BASELINE:1-score").alias("signal"), (-s).alias("value"))]
    wrong = (~F.col(correct).cast("boolean")).cast("int")
    pred = (F.col(prediction).cast("int") if prediction in records.columns
            else F.lit(None).cast("int"))
    base = records.select(*by, F.col(group).cast("string").alias("_group"), pred.alias("_pred"),
                          wrong.alias("_wrong"), F.array(*values).alias("_values"))
    base = materialise(base)    # read twice below, and often costly to derive

    def scoped(df: DataFrame) -> DataFrame:
        scopes = F.array_compact(F.array(
            F.lit(POOLED), F.when(F.col("_pred").isNotNull(),
                                  F.concat(F.lit("pred="), F.col("_pred").cast("string"))),
            F.col("_group")))
        return df.withColumn("scope", F.explode(scopes))

    sizes = scoped(base.groupBy(*by, "_group", "_pred").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_wrong").alias("n_errors")))
    sizes = sizes.groupBy(*by, "scope").agg(F.sum("n").alias("n"),
                                            F.sum("n_errors").alias("n_errors"))
    mixed = (F.col("n_errors") > 0) & (F.col("n_errors") < F.col("n"))
    sizes = sizes.where((F.col("scope") == POOLED) | mixed)

    # Collapse before fanning out to scopes, so the fan-out copies cells, not rows.
    long = base.select(*by, "_group", "_pred", "_wrong",
                       F.explode("_values").alias("_v")).select(
        *by, "_group", "_pred", "_wrong", "_v.signal", "_v.value")
    collapsed = cells(long, [*by, "signal", "_group", "_pred"], "value",
                      {"n": F.lit(1), "n_pos": F.col("_wrong")})
    baseline = F.col("signal").startswith("BASELINE:")
    fanned = scoped(collapsed).where(
        ~(baseline & (F.col("scope") == F.col("_group"))))
    keys = [*by, "signal", "scope"]
    ranking, parts = ranked_parts(fanned, keys, "value",
                                  {"n": F.col("n"), "n_pos": F.col("n_pos")}, costly=n_boot > 0)
    # A few rows, read for the table and for the baseline level.
    points = materialise(rank_metrics_of(ranking, keys).select(*keys, "auroc"))
    # A signal without a single finite value still gets its rows, with an unknown AUROC.
    listed = names + (["BASELINE:score", "BASELINE:1-score"] if score in records.columns else [])
    frame = sizes.withColumn("signal", F.explode(F.array(*[F.lit(s) for s in listed])))
    scope_is_group = ~((F.col("scope") == POOLED) | F.col("scope").startswith("pred="))
    frame = frame.where(~(baseline & scope_is_group)).join(points, keys, "left")
    frame = _with_intervals(frame, parts, keys, "value", ["auroc"], n_boot, seed)
    one = F.lit(0).alias("_all")
    level = (points.where(baseline & (F.col("scope") == POOLED))
             .groupBy(*by, one).agg(F.max("auroc").alias("_level")))
    frame = attach_groups(frame.withColumn("_all", F.lit(0)), level, [*by, "_all"])
    level = F.coalesce("_level", F.lit(0.5))
    lo, hi = F.col("auroc_ci_lo"), F.col("auroc_ci_hi")
    headline = (F.col("scope") == POOLED) & ~baseline
    return frame.select(
        *keys, "n", "n_errors", F.col("auroc").alias("err_auroc"),
        lo.alias("ci_lo"), hi.alias("ci_hi"),
        F.coalesce(lo > 0.5, F.lit(False)).alias("informative"),
        F.coalesce(hi < 0.5, F.lit(False)).alias("misleading"),
        F.when(headline, F.col("auroc") - level).alias("excess_over_baseline"),
        F.coalesce(headline & (lo > level), F.lit(False)).alias("beats_baseline"))
