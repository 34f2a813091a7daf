"""Conformal calibration, prediction sets and temperature scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.parts import P, sql_fan, sql_mode, sql_rank, sql_scored, sql_thr, sql_u01
from catalog.registry import Inputs, query
from catalog.replicates import binomial_parts
from surety.functions.columns import (MODES, calibration_sd, pvalue_uncertainty, widen)
from surety.operators import conformal, prediction_sets, temperature
from surety.plans.joins import require_none

DELTAS = [0.01, 0.05, 0.1, 0.2]


def pool(v: Inputs, view: str = "evt"):
    r = v(view)
    return r.where((F.col("split") == "train") & (F.col("label") == 0))


def test(v: Inputs, view: str = "evt"):
    return v(view).where(F.col("split") == "test")


def scored(v: Inputs, view: str = "evt"):
    return conformal.calibrate(v(view))[0]


@query("c1_conformal_quantile", """
SELECT category, 0.05::DOUBLE AS delta, CAST(n_cal AS BIGINT) AS n_cal, threshold FROM {doc_thr}""",
       {"doc_cal": "SELECT * FROM {doc} WHERE split = 'train' AND label = 0",
        "doc_thr": sql_thr("{doc_cal}")})
def _(v):
    return conformal.thresholds(conformal.calibration_pool(pool(v, "doc")), [0.05])


@query("c2_conformal_pvalue", "SELECT image_id, category, anomaly_score, conformal_p FROM {scored}", P)
def _(v):
    out = conformal.conformal_pvalues(test(v), conformal.calibration_pool(pool(v)))
    return out.select("image_id", "category", "anomaly_score", "conformal_p")


@query("c2_conformal_pvalue_ties",
       "SELECT image_id, category, anomaly_score, conformal_p FROM {vscored}",
       {"vcal": "SELECT * FROM {vote} WHERE split = 'train' AND label = 0 AND anomaly_score IS NOT NULL",
        "vthr": sql_thr("{vcal}"), "vscored": sql_scored("{vote}", "{vcal}", "{vthr}")})
def _(v):
    out = conformal.conformal_pvalues(test(v, "vote"),
                                      conformal.calibration_pool(pool(v, "vote")))
    return out.select("image_id", "category", "anomaly_score", "conformal_p")


@query("c3_randomized_pvalue", f"""
SELECT t.image_id, (1.0::DOUBLE + gt + {sql_u01("'1'", 't.image_id')} * (1.0::DOUBLE + eq)) / (n + 1.0::DOUBLE)
  AS conformal_p
FROM (SELECT t.image_id, count(CASE WHEN c.anomaly_score > t.anomaly_score THEN 1 END) AS gt,
        count(CASE WHEN c.anomaly_score = t.anomaly_score THEN 1 END) AS eq, count(*) AS n
      FROM {{vote}} t JOIN {{vcal}} c ON c.category = t.category
      WHERE t.split = 'test' GROUP BY t.image_id) t""",
       {"vcal": "SELECT * FROM {vote} WHERE split = 'train' AND label = 0 AND anomaly_score IS NOT NULL"})
def _(v):
    out = conformal.conformal_pvalues(
        test(v, "vote"), conformal.calibration_pool(pool(v, "vote")), randomized=True, seed=0)
    return out.select("image_id", "conformal_p")


_CAPPED = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category
  ORDER BY {sql_u01("'7'", 'image_id')}, image_id) AS rn FROM {{cal}}) r WHERE rn <= 100"""


@query("c4_mondrian_fit", """
SELECT category, CAST(n_cal AS BIGINT) AS n_cal, threshold FROM {cthr}""",
       {**P, "capped": _CAPPED, "cthr": sql_thr("{capped}")})
def _(v):
    model = conformal.MondrianConformal(seed=7).fit(pool(v), n_cal=100)
    return model.fitted.select("category", "n_cal", "threshold")


@query("c5_mondrian_transform", """
SELECT image_id, category, label, anomaly_score, conformal_p, conformal_pred, u_conformal,
  'boundary' AS conformal_mode FROM {scored}""", P)
def _(v):
    model = conformal.MondrianConformal(delta=0.05).fit(pool(v))
    return model.transform(test(v)).select(
        "image_id", "category", "label", "anomaly_score", "conformal_p", "conformal_pred",
        "u_conformal", "conformal_mode")


@query("c6_calibrate_stage", "SELECT image_id, conformal_pred, correct FROM {scored}", P)
def _(v):
    return scored(v).select("image_id", "conformal_pred", "correct")


@query("c6_calibrate_stage_line", """
SELECT category, CAST(count(*) AS BIGINT) AS n, CAST(sum(conformal_pred) AS BIGINT) AS n_flagged,
  CAST(sum(CAST(correct AS INT)) AS BIGINT) AS n_correct, round(avg(conformal_p), 9) AS mean_p
FROM {lscored} GROUP BY category""",
       {"lcal": "SELECT * FROM {line} WHERE split = 'train' AND label = 0",
        "lthr": sql_thr("{lcal}"), "lscored": sql_scored("{line}", "{lcal}", "{lthr}")})
def _(v):
    return scored(v, "line").groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("conformal_pred").alias("n_flagged"),
        F.sum(F.col("correct").cast("int")).alias("n_correct"),
        F.round(F.avg("conformal_p"), 9).alias("mean_p"))


def _sd(n: str, delta: str) -> str:
    k = f"ceil(({n} + 1) * (1.0::DOUBLE - {delta}))"
    b = f"({n} + 1.0::DOUBLE - {k})"
    t = f"({k} + {b})"
    return (f"CASE WHEN {n} > 0 AND {k} <= {n} THEN "
            f"sqrt({k} * {b} / ({t} * {t} * ({t} + 1.0::DOUBLE))) END")


_SWEEP = {
    **P,
    "deltas": " UNION ALL ".join(f"SELECT {d}::DOUBLE AS delta" for d in DELTAS),
    "dthr": """SELECT category, delta, max(n) AS n_cal, coalesce(max(CASE WHEN
      rn = CAST(ceil((n + 1) * (1.0::DOUBLE - delta)) AS BIGINT) THEN s END), 'inf'::DOUBLE) AS threshold
      FROM (SELECT category, anomaly_score AS s, row_number() OVER (PARTITION BY category ORDER BY anomaly_score) AS rn,
        count(*) OVER (PARTITION BY category) AS n FROM {cal}) r, {deltas} GROUP BY category, delta""",
    "per": f"""SELECT t.category AS "group", d.delta, count(*) AS n_normal_test,
      sum(CASE WHEN t.anomaly_score IS NOT NULL AND t.anomaly_score <= d.threshold THEN 1 ELSE 0 END) AS hits,
      max(d.n_cal) AS n_cal, max({_sd('d.n_cal', 'd.delta')}) AS calib_sd, max(d.threshold) AS threshold
      FROM {{evt}} t JOIN {{dthr}} d ON d.category = t.category
      WHERE t.split = 'test' AND t.label = 0 GROUP BY 1, 2""",
    "cover": """SELECT "group", delta, n_normal_test, hits, n_cal, calib_sd, threshold FROM {per}
      UNION ALL SELECT 'POOLED', delta, sum(n_normal_test), sum(hits), sum(n_cal),
        avg(calib_sd) / sqrt(count(*)), NULL FROM {per} GROUP BY delta""",
}
_COVER_COLUMNS = """"group", delta, CAST(n_normal_test AS BIGINT) AS n_normal_test,
  round(1.0::DOUBLE - delta, 9) AS nominal, round(hits::DOUBLE / n_normal_test, 9) AS empirical_coverage,
  CAST(n_cal AS BIGINT) AS n_cal, round(calib_sd, 9) AS calib_sd, threshold"""


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@query("c7_coverage_report", f"SELECT {_COVER_COLUMNS} FROM {{cover}} WHERE delta = 0.05::DOUBLE", _SWEEP)
def _(v):
    model = conformal.MondrianConformal(delta=0.05).fit(pool(v))
    out = conformal.coverage_report(test(v), model, n_boot=0).withColumn("delta", F.lit(0.05))
    return _rounded(out, "nominal", "empirical_coverage", "calib_sd").drop(
        "ci_lo", "ci_hi", "ci_lo_total", "ci_hi_total")


def _wide(bound: str, sign: str) -> str:
    return (f"least(greatest(share {sign} sqrt(abs({bound} - share) * abs({bound} - share) + (1.96::DOUBLE * calib_sd) * (1.96::DOUBLE * calib_sd)), 0.0::DOUBLE), 1.0::DOUBLE)")


_COVER_CI = {**_SWEEP, "cover5": "SELECT *, hits::DOUBLE / n_normal_test AS share FROM {cover} WHERE delta = 0.05::DOUBLE",
             **binomial_parts("{cover5}", "hits", "n_normal_test", 1000, "cov")}


@query("c7_coverage_report_intervals", f"""SELECT "group", CAST(n_normal_test AS BIGINT) AS n_normal_test, round(1.0::DOUBLE - delta, 9) AS nominal,
  round(share, 9) AS empirical_coverage, round(ci_lo, 9) AS ci_lo, round(ci_hi, 9) AS ci_hi, CAST(n_cal AS BIGINT) AS n_cal, round(calib_sd, 9) AS calib_sd,
  round({_wide('ci_lo', '-')}, 9) AS ci_lo_total, round({_wide('ci_hi', '+')}, 9) AS ci_hi_total, threshold
FROM {{cover5}} c JOIN {{cov_ci}} i ON i.hits = c.hits AND i.total = c.n_normal_test""", _COVER_CI)
def _(v):
    model = conformal.MondrianConformal(delta=0.05).fit(pool(v))
    out = conformal.coverage_report(test(v), model, n_boot=1000)
    return _rounded(out, "nominal", "empirical_coverage", "ci_lo", "ci_hi", "calib_sd", "ci_lo_total", "ci_hi_total")


@query("c8_calibration_sd", f"""
SELECT d.category, e.delta, CAST(n_cal AS BIGINT) AS n_cal, round({_sd('n_cal', 'e.delta')}, 9) AS calib_sd
FROM {{dthr}} d JOIN {{deltas}} e ON e.delta = d.delta""", _SWEEP)
def _(v):
    out = conformal.thresholds(conformal.calibration_pool(pool(v)), DELTAS)
    sd = F.coalesce(*[F.when(F.col("delta") == d, calibration_sd(F.col("n_cal"), d))
                      for d in DELTAS])
    return out.select("category", "delta", "n_cal", F.round(sd, 9).alias("calib_sd"))


@query("c9_interval_widening", f"""
SELECT category, round(greatest(0, c - sqrt((c - lo) * (c - lo) + (1.96::DOUBLE * sd) * (1.96::DOUBLE * sd))), 9) AS lo_total,
  round(least(1, c + sqrt((hi - c) * (hi - c) + (1.96::DOUBLE * sd) * (1.96::DOUBLE * sd))), 9) AS hi_total
FROM (SELECT category, c, c - 0.02::DOUBLE AS lo, least(1, c + 0.02::DOUBLE) AS hi, {_sd('n', '0.05::DOUBLE')} AS sd
  FROM (SELECT category, count(anomaly_score) AS n, avg(label) AS c FROM {{evt}} GROUP BY category) q) r""")
def _(v):
    base = v("evt").groupBy("category").agg(F.count("anomaly_score").alias("n"),
                                            F.avg("label").alias("c"))
    sd = calibration_sd(F.col("n"), 0.05)
    lo, hi = F.col("c") - 0.02, F.least(F.lit(1.0), F.col("c") + 0.02)
    return base.select("category", F.round(widen(lo, F.col("c"), sd, -1), 9).alias("lo_total"),
                       F.round(widen(hi, F.col("c"), sd, +1), 9).alias("hi_total"))


@query("c10_delta_sweep", f"SELECT {_COVER_COLUMNS} FROM {{cover}}", _SWEEP)
def _(v):
    out = conformal.coverage_sweep(test(v), conformal.calibration_pool(pool(v)), DELTAS, n_boot=0)
    return _rounded(out, "nominal", "empirical_coverage", "calib_sd").drop(
        "ci_lo", "ci_hi", "ci_lo_total", "ci_hi_total")


@query("c11_n_cal_sensitivity", f"""
SELECT delta, CAST(size AS BIGINT) AS n_cal, round(1.0::DOUBLE - delta, 9) AS nominal,
  round(avg(cov), 9) AS coverage_mean,
  round(stddev_pop(cov), 9) AS coverage_std, count(*) AS n_repeats
FROM (SELECT 0.05::DOUBLE AS delta, d.size, d.rep, sum(CASE WHEN t.anomaly_score <= d.threshold THEN 1 ELSE 0 END)::DOUBLE
        / count(*) AS cov
      FROM {{evt}} t JOIN {{lim}} d ON d.category = t.category
      WHERE t.split = 'test' AND t.label = 0 GROUP BY 2, 3) q
GROUP BY delta, size""",
       {**P,
        "reps": "SELECT unnest(range(5)) AS rep", "sizes": "SELECT unnest([25, 50, 100, 200]) AS size",
        "draws": f"""SELECT category, rep, size, anomaly_score FROM (
          SELECT *, row_number() OVER (PARTITION BY rep, category ORDER BY {sql_u01('rep', 'image_id')}, image_id) AS rn
          FROM {{cal}}, {{reps}}) r, {{sizes}} WHERE rn <= size""",
        "lim": f"""SELECT category, size, rep, coalesce(max(CASE WHEN rn = {sql_rank('n')} THEN s END), 'inf'::DOUBLE) AS threshold
          FROM (SELECT category, size, rep, anomaly_score AS s,
            row_number() OVER (PARTITION BY category, size, rep ORDER BY anomaly_score) AS rn,
            count(*) OVER (PARTITION BY category, size, rep) AS n FROM {{draws}}) r GROUP BY 1, 2, 3
          UNION ALL SELECT category, -1, 0, threshold FROM {{thr}}"""})
def _(v):
    out = conformal.n_cal_sensitivity(pool(v), test(v))
    return _rounded(out, "nominal", "coverage_mean", "coverage_std")


_SETS = {
    **P,
    "synanom": "SELECT * FROM {syn} WHERE synthetic_anomaly = 1 AND anomaly_score IS NOT NULL",
    "setp": """SELECT t.image_id, t.category, t.label, t.anomaly_score,
      (1.0::DOUBLE + (SELECT count(*) FROM {cal} c WHERE c.category = t.category AND c.anomaly_score >= t.anomaly_score))
        / (1.0::DOUBLE + (SELECT count(*) FROM {cal} c WHERE c.category = t.category)) AS p_normal,
      (1.0::DOUBLE + (SELECT count(*) FROM {synanom} c WHERE c.category = t.category AND c.anomaly_score <= t.anomaly_score))
        / (1.0::DOUBLE + (SELECT count(*) FROM {synanom} c WHERE c.category = t.category)) AS p_anomalous
      FROM {evt} t WHERE t.split = 'test'""",
    "sets": """SELECT *, CAST(kn AS INT) + CAST(ka AS INT) AS set_size,
      CASE WHEN kn AND ka THEN '{normal,anomalous}' WHEN kn THEN '{normal}' WHEN ka THEN '{anomalous}'
        ELSE concat('{', '}') END AS set_label
      FROM (SELECT *, p_normal > 0.05::DOUBLE AS kn, p_anomalous > 0.05::DOUBLE AS ka FROM {setp}) q""",
}
# Literal braces in the labels are not view names.
_SETS["sets"] = (_SETS["sets"].replace("'{normal,anomalous}'", "concat('{', 'normal,anomalous', '}')")
                 .replace("'{normal}'", "concat('{', 'normal', '}')")
                 .replace("'{anomalous}'", "concat('{', 'anomalous', '}')"))


def _prediction_sets(v):
    return prediction_sets.prediction_set_stage(test(v), pool(v), v("syn"))


@query("c12_prediction_sets", """
SELECT image_id, p_normal, p_anomalous, set_size, set_label,
  CASE set_size WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS u_set_size,
  set_size = 0 AS set_is_ood FROM {sets}""", _SETS)
def _(v):
    anomalies = v("syn").where(F.col("synthetic_anomaly") == 1)
    return prediction_sets.prediction_sets(test(v), pool(v), anomalies).select(
        "image_id", "p_normal", "p_anomalous", "set_size", "set_label", "u_set_size",
        "set_is_ood")


_SET_REPORT = """
SELECT grp AS "group", count(*) AS n,
  round(avg(CAST(set_size = 0 AS INT)), 9) AS frac_size0, round(avg(CAST(set_size = 1 AS INT)), 9) AS frac_size1,
  round(avg(CAST(set_size = 2 AS INT)), 9) AS frac_size2, round(avg(set_size), 9) AS mean_set_size,
  round(sum(ok)::DOUBLE / count(*), 9) AS frac_size1_correct,
  round(sum(ok)::DOUBLE / nullif(count(CASE WHEN set_size = 1 THEN 1 END), 0), 9) AS singleton_accuracy,
  round(avg(CASE WHEN label = 0 THEN CAST(set_size = 0 AS INT) END), 9) AS frac_size0_on_normal,
  round(avg(CASE WHEN label = 1 THEN CAST(set_size = 0 AS INT) END), 9) AS frac_size0_on_anomalous
FROM (SELECT *, CASE WHEN set_size = 1 AND ((ka AND label = 1) OR (kn AND label = 0)) THEN 1 ELSE 0 END AS ok
      FROM """ + sql_fan("{sets}") + """ f) q GROUP BY grp"""
_SET_COLUMNS = ["frac_size0", "frac_size1", "frac_size2", "mean_set_size", "frac_size1_correct",
                "singleton_accuracy", "frac_size0_on_normal", "frac_size0_on_anomalous"]


@query("c13_set_size_report", _SET_REPORT, _SETS)
def _(v):
    anomalies = v("syn").where(F.col("synthetic_anomaly") == 1)
    sets = prediction_sets.prediction_sets(test(v), pool(v), anomalies)
    return _rounded(prediction_sets.set_size_report(sets), *_SET_COLUMNS)


@query("c14_prediction_set_stage", """
SELECT set_label, CAST(count(*) AS BIGINT) AS n, CAST(sum(label) AS BIGINT) AS n_anomalous
FROM {sets} GROUP BY set_label""", _SETS)
def _(v):
    rows, _report = _prediction_sets(v)
    return rows.groupBy("set_label").agg(F.count(F.lit(1)).alias("n"),
                                         F.sum("label").alias("n_anomalous"))


_LOGIT = "ln({c} / (1.0::DOUBLE - {c}))".replace(
    "{c}", "least(greatest(anomaly_score, 1e-9::DOUBLE), 1.0::DOUBLE - 1e-9::DOUBLE)")


def _losses(grid: str) -> str:
    """Mean negative log-likelihood of ``sigmoid(z / exp(t))`` at every ``t`` of a grid."""
    return f"""SELECT t, avg(-(label * ln(p) + (1 - label) * ln(1.0::DOUBLE - p))) AS loss FROM (SELECT label, t, least(greatest(
      1.0::DOUBLE / (1.0::DOUBLE + exp(-z / exp(t))), 1e-12::DOUBLE), 1.0::DOUBLE - 1e-12::DOUBLE) AS p FROM {{z}}, {grid}) q GROUP BY t"""


@query("c15_temperature", "SELECT round(min(loss), 6) AS loss, (SELECT count(*) FROM {z}) AS n FROM {fine}", {
    "z": f"SELECT label, {_LOGIT} AS z FROM {{evt}} WHERE anomaly_score IS NOT NULL",
    "coarse": _losses("(SELECT unnest(range(-46, 47)) * 0.1::DOUBLE AS t) g"),
    "top": "SELECT arg_min(t, loss) AS t FROM {coarse}",
    "fine": _losses("(SELECT t + unnest(range(-100, 101)) * 0.001::DOUBLE AS t FROM {top}) g")})
def _(v):
    """The likelihood at the fitted temperature, against the best of a fine grid."""
    from surety.functions.columns import clip, finite, logistic, logit
    records = v("evt").where(finite(F.col("anomaly_score")))
    t = temperature.fit_temperature(records)
    p = clip(logistic(logit(F.col("anomaly_score")) / F.lit(t)), 1e-12, 1 - 1e-12)
    loss = F.avg(-(F.col("label") * F.log(p) + (1 - F.col("label")) * F.log(F.lit(1.0) - p)))
    return records.agg(F.round(loss, 6).alias("loss"), F.count(F.lit(1)).alias("n"))


@query("c15_temperature_applied", f"""
SELECT image_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({_LOGIT}) / 2.5::DOUBLE)), 9) AS p_temperature
FROM {{evt}} WHERE anomaly_score IS NOT NULL""")
def _(v):
    out = temperature.apply_temperature(v("evt").where(F.col("anomaly_score").isNotNull()), 2.5)
    return out.select("image_id", F.round("p_temperature", 9).alias("p_temperature"))


# The voting scorer's calibration pool judged on the main scorer's test rows.
@query("c17_cross_dataset_coverage", """
SELECT s.delta, round(1.0::DOUBLE - s.delta, 9) AS nominal,
  round(s.hits::DOUBLE / s.n, 9) AS source_coverage, round(t.hits::DOUBLE / t.n, 9) AS target_coverage,
  round(s.hits::DOUBLE / s.n - t.hits::DOUBLE / t.n, 9) AS coverage_gap
FROM (SELECT d.delta, count(*) AS n, sum(CASE WHEN r.anomaly_score <= d.threshold THEN 1 ELSE 0 END) AS hits
      FROM {evt} r JOIN {dthr} d ON d.category = r.category WHERE r.split = 'test' AND r.label = 0 GROUP BY 1) s
JOIN (SELECT d.delta, count(*) AS n, sum(CASE WHEN r.anomaly_score <= d.threshold THEN 1 ELSE 0 END) AS hits
      FROM {evt_b} r JOIN {dthr} d ON d.category = r.category WHERE r.split = 'test' AND r.label = 0 GROUP BY 1) t
  ON s.delta = t.delta""", _SWEEP)
def _(v):
    out = conformal.cross_dataset_coverage(pool(v), test(v), test(v, "evt_b"), DELTAS, n_boot=200)
    return _rounded(out, "nominal", "source_coverage", "target_coverage", "coverage_gap").drop(
        "source_ci_lo", "source_ci_hi", "target_ci_lo", "target_ci_hi", "target_undercovers")


# All target rows against one pool of all groups; the source rows keep their groups and match none.
@query("c17_cross_dataset_pooled", """
SELECT d.delta, round(1.0::DOUBLE - d.delta, 9) AS nominal, 0.0::DOUBLE AS source_coverage,
  round(sum(CASE WHEN r.anomaly_score <= d.threshold THEN 1 ELSE 0 END)::DOUBLE / count(*), 9) AS target_coverage
FROM (SELECT * FROM {evt_b} WHERE split = 'test' AND label = 0) r, {pooled_thr} d GROUP BY d.delta""", {
    **_SWEEP, "pooled_thr": """SELECT delta, coalesce(max(CASE WHEN rn = CAST(ceil((n + 1) * (1.0::DOUBLE - delta)) AS BIGINT) THEN s END), 'inf'::DOUBLE) AS threshold
      FROM (SELECT anomaly_score AS s, row_number() OVER (ORDER BY anomaly_score) AS rn, count(*) OVER () AS n FROM {cal}) r, {deltas} GROUP BY delta"""})
def _(v):
    out = conformal.cross_dataset_coverage(pool(v), test(v), test(v, "evt_b"), DELTAS, n_boot=200, pool_groups=True)
    return _rounded(out, "nominal", "source_coverage", "target_coverage").select(
        "delta", "nominal", F.coalesce("source_coverage", F.lit(0.0)).alias("source_coverage"), "target_coverage")


_MODES = ", ".join(f"round({sql_mode('conformal_p', m)}, 9) AS u_conformal_{m}" for m in MODES)


@query("p19_pvalue_uncertainty", f"""
SELECT image_id, {', '.join(f"round({sql_mode('anomaly_score', m, 0.1, 2.0)}, 9) AS u_{m}" for m in MODES)}
FROM {{evt}}""")
def _(v):
    s = F.col("anomaly_score")
    return v("evt").select("image_id", *[
        F.round(pvalue_uncertainty(s, m, 0.1, 2.0), 9).alias(f"u_{m}") for m in MODES])


@query("p20_uncertainty_modes", f"SELECT image_id, {_MODES} FROM {{scored}}", P)
def _(v):
    out = conformal.uncertainty_modes(scored(v), MODES)
    return out.select("image_id", *[F.round(f"u_conformal_{m}", 9).alias(f"u_conformal_{m}")
                                    for m in MODES])


@query("j4_test_vs_pool_counts", """
SELECT t.image_id, count(CASE WHEN c.anomaly_score >= t.anomaly_score THEN 1 END) AS n_ge,
  count(CASE WHEN c.anomaly_score <= t.anomaly_score THEN 1 END) AS n_le
FROM {evt} t JOIN {cal} c ON c.category = t.category
WHERE t.split = 'test' GROUP BY t.image_id""", P)
def _(v):
    out = conformal.pool_counts(test(v), {"n": conformal.calibration_pool(pool(v))})
    return out.select("image_id", F.col("n_ge").cast("bigint").alias("n_ge"),
                      F.col("n_le").cast("bigint").alias("n_le"))


@query("j5_test_vs_thresholds", """
SELECT t.image_id, c.threshold, coalesce(t.anomaly_score > c.threshold, false) AS flagged
FROM {evt} t JOIN {thr} c ON c.category = t.category WHERE t.split = 'test'""", P)
def _(v):
    model = conformal.MondrianConformal().fit(pool(v))
    rows = test(v)
    require_none(rows.join(model.fitted, "category", "left_anti"), "uncalibrated group")
    out = rows.join(model.fitted, "category")
    return out.select("image_id", "threshold", F.coalesce(
        F.col("anomaly_score") > F.col("threshold"), F.lit(False)).alias("flagged"))


@query("j9_settings_grid", """
SELECT delta, sum(n_at_most)::BIGINT AS n_at_most FROM (
  SELECT d.delta, d.category, count(CASE WHEN t.anomaly_score <= d.threshold THEN 1 END) AS n_at_most
  FROM {dthr} d JOIN {evt} t ON t.category = d.category GROUP BY 1, 2) q GROUP BY delta""", _SWEEP)
def _(v):
    limits = conformal.thresholds(conformal.calibration_pool(pool(v)), DELTAS)
    out = conformal.counts_at_most(v("evt"), limits, "anomaly_score", "category")
    return out.groupBy("delta").agg(F.sum("n_at_most").alias("n_at_most"))


@query("j11_shared_groups", """
SELECT category, count(*) AS n FROM {evt} WHERE split = 'test' AND category IN (SELECT category FROM {cal} WHERE anomaly_score > 0.55)
GROUP BY category""", P)
def _(v):
    calibrated = conformal.calibration_pool(pool(v).where(F.col("anomaly_score") > 0.55))
    return conformal.shared_groups(test(v), calibrated).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
