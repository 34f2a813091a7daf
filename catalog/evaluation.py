"""Metrics, selective prediction and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.calibration import scored, test
from catalog.parts import P, sql_auroc, sql_clip, sql_curve, sql_fan, sql_unpivot
from catalog.registry import query
from catalog.replicates import binomial_parts, paired_parts, sql_key, sql_weights, stratified_parts
from surety.operators import bootstrap, conformal, inference, metrics, selective, signals
from surety.plans.ranking import with_pooled

SIGNALS = ["u_conformal", "u_conformal_log", "u_token_entropy", "u_verdict_var", "u_abstention"]


def signal_records(v, view: str = "evt"):
    """Calibrated test rows with five uncertainty signals.

    Two of them are symmetric in the score; rounding keeps their ties equal in both engines.
    """
    out = conformal.uncertainty_modes(scored(v, view), ["log"])
    out = signals.attach_signals(out, ["token_entropy", "verdict_var", "abstention"])
    return r9(out, "u_token_entropy", "u_verdict_var")


def r9(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


def fanned(v, view="evt"):
    return with_pooled(v(view).select("category", "anomaly_score", "label"))


_EVT = {"fan": "SELECT * FROM " + sql_fan("{evt}") + " f"}
_AUC = {**_EVT, "auc": sql_auroc("{fan}", "grp", "anomaly_score", "label")}


@query("m1_auroc", 'SELECT grp AS "group", n, n_pos, round(auroc, 9) AS auroc FROM {auc}', _AUC)
def _(v):
    return r9(metrics.auroc(fanned(v), ["group"]), "auroc")


@query("m1_auroc_line", 'SELECT grp AS "group", n, n_pos, round(auroc, 9) AS auroc FROM {auc}',
       {"fan": "SELECT * FROM " + sql_fan("{line}") + " f",
        "auc": sql_auroc("{fan}", "grp", "anomaly_score", "label")})
def _(v):
    return r9(metrics.auroc(fanned(v, "line"), ["group"]), "auroc")


@query("m1_auroc_ties", 'SELECT grp AS "group", n, n_pos, round(auroc, 9) AS auroc FROM {auc}',
       {"fan": "SELECT * FROM " + sql_fan("{vote}") + " f",
        "auc": sql_auroc("{fan}", "grp", "anomaly_score", "label")})
def _(v):
    return r9(metrics.auroc(fanned(v, "vote"), ["group"]), "auroc")


@query("m2_average_precision", 'SELECT grp AS "group", n, n_pos, round(aupr, 9) AS aupr FROM {auc}', _AUC)
def _(v):
    return r9(metrics.average_precision(fanned(v), ["group"]), "aupr")


@query("m3_brier", """SELECT grp AS "group", round(avg((anomaly_score - label) * (anomaly_score - label)), 9) AS brier
FROM {fan} WHERE anomaly_score IS NOT NULL GROUP BY grp""", _EVT)
def _(v):
    return r9(metrics.brier(fanned(v), ["group"]), "brier")


_NLL = f"-(label * ln({sql_clip('anomaly_score')}) + (1 - label) * ln(1.0::DOUBLE - {sql_clip('anomaly_score')}))"


@query("m4_nll", f"""SELECT grp AS "group", round(avg({_NLL}), 9) AS nll
FROM {{fan}} WHERE anomaly_score IS NOT NULL GROUP BY grp""", _EVT)
def _(v):
    return r9(metrics.nll(fanned(v), ["group"]), "nll")


_QUANTILES = ", ".join(f"{i / 15!r}" for i in range(16))
_ECE = {
    **_EVT,
    "edges": f"""SELECT grp, list_sort(list_distinct(quantile_cont(anomaly_score, [{_QUANTILES}]))) AS edges
      FROM {{fan}} WHERE anomaly_score IS NOT NULL GROUP BY grp""",
    "bins": """SELECT f.grp, greatest(least(len(list_filter(e.edges, lambda x: x <= f.anomaly_score)) - 1, len(e.edges) - 2), 0) AS bin,
      count(*) AS n, avg(f.label) AS acc, avg(f.anomaly_score) AS conf
      FROM {fan} f JOIN {edges} e ON e.grp = f.grp WHERE f.anomaly_score IS NOT NULL GROUP BY 1, 2""",
    "wbins": """SELECT grp, greatest(least(CAST(len(list_filter([""" + _QUANTILES + """]::DOUBLE[], lambda x: x <= anomaly_score)) AS INT) - 1, 14), 0) AS bin,
      count(*) AS n, avg(label) AS acc, avg(anomaly_score) AS conf
      FROM {fan} WHERE anomaly_score IS NOT NULL GROUP BY 1, 2""",
}


@query("m5_ece", """SELECT a."group", a.ece_adaptive, b.ece_equalwidth FROM
 (SELECT grp AS "group", round(sum(n * abs(acc - conf)) / sum(n), 9) AS ece_adaptive FROM {bins} GROUP BY grp) a JOIN
 (SELECT grp AS "group", round(sum(n * abs(acc - conf)) / sum(n), 9) AS ece_equalwidth FROM {wbins} GROUP BY grp) b
 ON a."group" = b."group" """, _ECE)
def _(v):
    rows = fanned(v)
    a = metrics.calibration_errors(rows, ["group"]).drop("mce_adaptive")
    b = metrics.calibration_errors(rows, ["group"], adaptive=False).drop("mce_equalwidth")
    return r9(a.join(b, "group"), "ece_adaptive", "ece_equalwidth")


@query("m6_mce", """SELECT grp AS "group", round(max(CASE WHEN n >= 5 THEN abs(acc - conf) END), 9) AS mce_adaptive
FROM {bins} GROUP BY grp""", _ECE)
def _(v):
    return r9(metrics.calibration_errors(fanned(v), ["group"]).drop("ece_adaptive"),
              "mce_adaptive")


@query("m7_reliability", """SELECT grp AS "group", CAST(bin AS INT) AS bin, round(conf, 9) AS mean_predicted,
  round(acc, 9) AS empirical_frequency, n AS bin_count FROM {bins}""", _ECE)
def _(v):
    return r9(metrics.reliability_curve(fanned(v), ["group"]),
              "mean_predicted", "empirical_frequency")


@query("m8_error_auroc", 'SELECT category, n, n_pos, round(auroc, 9) AS auroc FROM {eauc}',
       {**P, "wrong": "SELECT *, 1 - CAST(correct AS INT) AS wrong FROM {signals}",
        "eauc": sql_auroc("{wrong}", "category", "u_conformal", "wrong")})
def _(v):
    return r9(metrics.error_auroc(scored(v), ["category"], "u_conformal"), "auroc")


@query("m9_detection_table", """
WITH t AS (SELECT f.grp AS "group", f.n, f.n_anomalous, a.auroc, a.aupr FROM
  (SELECT grp, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_anomalous FROM {fan} GROUP BY grp) f
  LEFT JOIN {auc} a ON a.grp = f.grp)
SELECT "group", n, n_anomalous, round(auroc, 9) AS auroc, round(aupr, 9) AS aupr FROM t
UNION ALL SELECT 'MEAN_OF_CATEGORIES', CAST(sum(n) AS BIGINT), CAST(sum(n_anomalous) AS BIGINT),
  round(avg(auroc), 9), round(avg(aupr), 9) FROM t WHERE "group" <> 'POOLED'""".replace(
    "WITH t AS", "SELECT * FROM (WITH t AS") + ") z", _AUC)
def _(v):
    out = metrics.detection_table(v("evt"), n_boot=0)
    return r9(out.select("group", "n", "n_anomalous", "auroc", "aupr"), "auroc", "aupr")


_CI = ["auroc_ci_lo", "auroc_ci_hi", "aupr_ci_lo", "aupr_ci_hi"]
_CI_SQL = ", ".join(f"round({c}, 9) AS {c}" for c in _CI)
_NO_CI = ", ".join(f"NULL::DOUBLE AS {c}" for c in _CI)


@query("m9_detection_table_intervals", f"""SELECT * FROM (WITH t AS (SELECT f.grp AS "group", f.n, f.n_anomalous, a.auroc, a.aupr, {_CI_SQL} FROM
  (SELECT grp, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_anomalous FROM {{fan}} GROUP BY grp) f
  LEFT JOIN {{auc}} a ON a.grp = f.grp LEFT JOIN {{det_ci}} c ON c.k = f.grp)
SELECT "group", n, n_anomalous, round(auroc, 9) AS auroc, round(aupr, 9) AS aupr, {', '.join(_CI)} FROM t
UNION ALL SELECT 'MEAN_OF_CATEGORIES', CAST(sum(n) AS BIGINT), CAST(sum(n_anomalous) AS BIGINT),
  round(avg(auroc), 9), round(avg(aupr), 9), {_NO_CI} FROM t WHERE "group" <> 'POOLED') z""",
       {**_AUC, **stratified_parts("{fan}", ["grp"], "anomaly_score", "label", 200, "det")})
def _(v):
    return r9(metrics.detection_table(v("evt"), n_boot=200), "auroc", "aupr", *_CI)


_SIDES = {
    "sides": " UNION ALL ".join(f"SELECT '{side}' AS side, grp, anomaly_score, label FROM {sql_fan(view)} f WHERE split = 'test'"
                                for side, view in (("source", "{evt}"), ("target", "{evt_b}"))),
    "sided": "SELECT *, concat(side, ':', grp) AS k FROM {sides}",
    "side_auc": sql_auroc("{sided}", "k", "anomaly_score", "label"),
    **stratified_parts("{sides}", ["side", "grp"], "anomaly_score", "label", 100, "side"),
    "side_change": """SELECT split_part(k, ':', 2) AS grp, quantile_cont(da, 0.025) AS a_lo, quantile_cont(da, 0.975) AS a_hi,
        quantile_cont(dp, 0.025) AS p_lo, quantile_cont(dp, 0.975) AS p_hi FROM (
      SELECT t.k, t.auroc - s.auroc AS da, t.aupr - s.aupr AS dp FROM {side_draws} t
      JOIN {side_draws} s ON s.rep = t.rep AND s.k = replace(t.k, 'target:', 'source:') WHERE t.k LIKE 'target:%') q GROUP BY ALL""",
    "side_table": """SELECT c.side, c.grp, c.n, c.n_anomalous, a.auroc, a.aupr, i.auroc_ci_lo, i.auroc_ci_hi, i.aupr_ci_lo, i.aupr_ci_hi FROM
      (SELECT side, grp, k, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_anomalous FROM {sided} GROUP BY ALL) c
      LEFT JOIN {side_auc} a ON a.k = c.k LEFT JOIN {side_ci} i ON i.k = c.k""",
}
_SIDE_VALUES = ["auroc", "aupr", *_CI]
_SIDE_ROUNDED = ", ".join(f"round({x}.{c}, 9) AS {side}_{c}" for x, side in (("s", "source"), ("t", "target")) for c in _SIDE_VALUES)


@query("c17_cross_dataset_detection", f"""
SELECT coalesce(s.grp, t.grp) AS "group", s.n AS source_n, t.n AS target_n, s.n_anomalous AS source_n_anomalous,
  t.n_anomalous AS target_n_anomalous, {_SIDE_ROUNDED},
  round(t.auroc - s.auroc, 9) AS delta_auroc, round(t.aupr - s.aupr, 9) AS delta_aupr,
  round(d.a_lo, 9) AS delta_auroc_ci_lo, round(d.a_hi, 9) AS delta_auroc_ci_hi, round(d.p_lo, 9) AS delta_aupr_ci_lo, round(d.p_hi, 9) AS delta_aupr_ci_hi
FROM (SELECT * FROM {{side_table}} WHERE side = 'source') s FULL JOIN (SELECT * FROM {{side_table}} WHERE side = 'target') t ON s.grp = t.grp
LEFT JOIN {{side_change}} d ON d.grp = coalesce(s.grp, t.grp)""", {**P, **_SIDES})
def _(v):
    out = metrics.cross_dataset_detection(test(v), test(v, "evt_b"), n_boot=100)
    return r9(out, *[f"{side}_{c}" for side in ("source", "target") for c in _SIDE_VALUES],
              *[f"delta_{c}" for c in _SIDE_VALUES])


@query("m10_calibration_table", f"""
SELECT r."group", r.n, a.ece_adaptive, b.ece_equalwidth, a.mce, p.brier, p.nll FROM
 (SELECT grp AS "group", count(*) AS n FROM {{fan}} GROUP BY grp) r
 JOIN (SELECT grp AS "group", round(sum(n * abs(acc - conf)) / sum(n), 9) AS ece_adaptive,
   round(max(CASE WHEN n >= 5 THEN abs(acc - conf) END), 9) AS mce FROM {{bins}} GROUP BY grp) a ON a."group" = r."group"
 JOIN (SELECT grp AS "group", round(sum(n * abs(acc - conf)) / sum(n), 9) AS ece_equalwidth FROM {{wbins}} GROUP BY grp) b
   ON b."group" = r."group"
 JOIN (SELECT grp AS "group", round(avg((anomaly_score - label) * (anomaly_score - label)), 9) AS brier,
   round(avg({_NLL}), 9) AS nll FROM {{fan}} WHERE anomaly_score IS NOT NULL GROUP BY grp) p ON p."group" = r."group" """,
       _ECE)
def _(v):
    return r9(metrics.calibration_table(v("evt")), "ece_adaptive", "ece_equalwidth", "mce",
              "brier", "nll")


@query("m11_abstention_summary", """
SELECT grp AS category, count(*) AS n, count(CASE WHEN NOT parse_ok THEN 1 END) AS n_abstain,
  count(CASE WHEN NOT parse_ok THEN 1 END)::DOUBLE / count(*) AS abstention_rate,
  count(CASE WHEN parse_ok THEN 1 END) AS n_answered FROM {fan} GROUP BY grp""", _EVT)
def _(v):
    return metrics.abstention_summary(v("evt"))


_ALL = [(s, s) for s in SIGNALS] + [("BASELINE:score", "anomaly_score"),
                                    ("BASELINE:1-score", "-anomaly_score")]
_EP = {
    **P,
    "eplong": " UNION ALL ".join(
        f"""SELECT image_id, sc.scope, '{name}' AS signal, {expr} AS value, 1 - CAST(correct AS INT) AS wrong,
        concat('{name}', '|', sc.scope) AS k FROM {{signals}} s, LATERAL (SELECT unnest(
          {"['POOLED', concat('pred=', conformal_pred)" + ("" if name.startswith("BASELINE") else ", category") + "]"}) AS scope) sc"""
        for name, expr in _ALL),
    "epauc": sql_auroc("{eplong}", "k", "value", "wrong"),
    "epsize": """SELECT signal, scope, k, count(*) AS n, CAST(sum(wrong) AS BIGINT) AS n_errors
      FROM {eplong} GROUP BY 1, 2, 3""",
    "ep": """SELECT z.signal, z.scope, z.n, z.n_errors, a.auroc AS err_auroc FROM {epsize} z
      LEFT JOIN {epauc} a ON a.k = z.k
      WHERE z.scope = 'POOLED' OR (z.n_errors > 0 AND z.n_errors < z.n)""",
}


@query("m12_error_prediction", """
SELECT signal, scope, n, n_errors, round(err_auroc, 9) AS err_auroc,
  round(CASE WHEN scope = 'POOLED' AND NOT starts_with(signal, 'BASELINE:') THEN err_auroc -
    (SELECT max(err_auroc) FROM {ep} WHERE scope = 'POOLED' AND starts_with(signal, 'BASELINE:')) END, 9)
    AS excess_over_baseline FROM {ep}""", _EP)
def _(v):
    out = metrics.error_prediction_table(signal_records(v), SIGNALS, n_boot=0)
    return r9(out.select("signal", "scope", "n", "n_errors", "err_auroc",
                         "excess_over_baseline"), "err_auroc", "excess_over_baseline")


_EP_CI = {**_EP, **stratified_parts("{eplong}", ["signal", "scope"], "value", "wrong", 200, "err"), "epci": """
  SELECT e.signal, e.scope, e.n, e.n_errors, e.err_auroc, c.auroc_ci_lo AS lo, c.auroc_ci_hi AS hi,
    (SELECT max(err_auroc) FROM {ep} WHERE scope = 'POOLED' AND starts_with(signal, 'BASELINE:')) AS level,
    e.scope = 'POOLED' AND NOT starts_with(e.signal, 'BASELINE:') AS headline
  FROM {ep} e LEFT JOIN {err_ci} c ON c.k = concat(e.signal, ':', e.scope)"""}


@query("m12_error_prediction_intervals", """SELECT signal, scope, n, n_errors, round(err_auroc, 9) AS err_auroc, round(lo, 9) AS ci_lo, round(hi, 9) AS ci_hi,
  coalesce(lo > 0.5::DOUBLE, false) AS informative, coalesce(hi < 0.5::DOUBLE, false) AS misleading,
  round(CASE WHEN headline THEN err_auroc - level END, 9) AS excess_over_baseline,
  headline AND coalesce(lo > level, false) AS beats_baseline FROM {epci}""", _EP_CI)
def _(v):
    out = metrics.error_prediction_table(signal_records(v), SIGNALS, n_boot=200)
    return r9(out, "err_auroc", "ci_lo", "ci_hi", "excess_over_baseline")


@query("w1_risk_coverage_curve", """
SELECT image_id, CAST(k AS BIGINT) AS k, round(coverage, 9) AS coverage, round(risk, 9) AS risk FROM {curve}""",
       {**P, "curve": sql_curve("{signals}", "label", "u_conformal").replace(
           "PARTITION BY label", "PARTITION BY 1")})
def _(v):
    curve = selective.risk_coverage(scored(v), [], "u_conformal", abstain=~F.col("parse_ok"))
    return r9(curve.select("image_id", "k", "coverage", "risk"), "coverage", "risk")


_SEL = {**P, "sel": sql_unpivot("{signals}", "image_id, correct, parse_ok", SIGNALS),
        "selcurve": sql_curve("{sel}", "signal", "value")}


@query("w2_aurc", """SELECT signal, round(avg(risk), 9) AS aurc, round(avg(risk) - avg(oracle), 9) AS eaurc,
  CAST(max(n) AS BIGINT) AS n FROM {selcurve} GROUP BY signal""", _SEL)
def _(v):
    rows = signal_records(v)
    long = selective.signals_long(rows, ["image_id", "correct", "parse_ok"], SIGNALS)
    curve = selective.risk_coverage(long, ["signal"], "value", abstain=~F.col("parse_ok"))
    return r9(selective.area_summary(curve, ["signal"]), "aurc", "eaurc")


@query("w3_coverage_at_risk", """SELECT category, round(coalesce(max(CASE WHEN risk <= 0.1::DOUBLE THEN coverage END), 0), 9)
  AS coverage_at_risk FROM {ccurve} GROUP BY category""",
       {**P, "ccurve": sql_curve("{signals}", "category", "u_verdict_var")})
def _(v):
    curve = selective.risk_coverage(signal_records(v), ["category"], "u_verdict_var",
                                    abstain=~F.col("parse_ok"))
    return curve.groupBy("category").agg(
        F.round(selective.coverage_at_risk(0.1), 9).alias("coverage_at_risk"))


@query("w4_risk_at_coverage", """SELECT category, round(min_by(risk, k) FILTER (coverage >= 0.8::DOUBLE), 9) AS risk,
  round(1.0::DOUBLE - min_by(risk, k) FILTER (coverage >= 0.8::DOUBLE), 9) AS accuracy FROM {ccurve} GROUP BY category""",
       {**P, "ccurve": sql_curve("{signals}", "category", "u_verdict_var")})
def _(v):
    curve = selective.risk_coverage(signal_records(v), ["category"], "u_verdict_var",
                                    abstain=~F.col("parse_ok"))
    risk = selective.risk_at_coverage(0.8)
    return curve.groupBy("category").agg(F.round(risk, 9).alias("risk"),
                                         F.round(1.0 - risk, 9).alias("accuracy"))


_ACC = ", ".join(
    f'round(1.0::DOUBLE - min_by(risk, k) FILTER (coverage >= {c}::DOUBLE), 9) AS "acc@cov{c:g}"'
    for c in selective.COVERAGES)
_COV = ", ".join(
    f'round(coalesce(max(CASE WHEN risk <= {r}::DOUBLE THEN coverage END), 0), 9) AS "cov@risk{r:g}"'
    for r in selective.RISKS)


@query("w5_selective_table", f"""SELECT signal, round(avg(risk), 9) AS aurc, round(avg(risk) - avg(oracle), 9) AS eaurc,
  CAST(max(n) AS BIGINT) AS n, {_ACC}, {_COV} FROM {{selcurve}} GROUP BY signal""", _SEL)
def _(v):
    out = selective.selective_table(signal_records(v), SIGNALS)
    return out.select("signal", "n", *[F.round(F.col(f"`{c}`"), 9).alias(c) for c in out.columns
                                       if c not in ("signal", "n")])


@query("j2_scorer_alignment", """
SELECT a.image_id, a.category, a.label, a.anomaly_score AS score_a, round(b.anomaly_score, 9) AS score_b
FROM {evt} a JOIN {evt_b} b ON a.image_id = b.image_id""")
def _(v):
    return r9(inference.align_scorers(v("evt"), v("evt_b")), "score_b")


@query("j2_overlap_counts", """
SELECT (SELECT count(*) FROM {evt} WHERE split = 'test') AS n_a, (SELECT count(*) FROM {evt_b} WHERE label = 0) AS n_b,
  (SELECT count(*) FROM {evt} a JOIN {evt_b} b ON a.image_id = b.image_id WHERE a.split = 'test' AND b.label = 0) AS n_shared""")
def _(v):
    return inference.overlap_counts(test(v), v("evt_b").where(F.col("label") == 0))


def _placed(side: str) -> str:
    return f"""SELECT grp, image_id, label,
      CASE WHEN label = 1 THEN (cn + en / 2.0::DOUBLE) / nn ELSE 1.0::DOUBLE - (cp + ep / 2.0::DOUBLE) / np END AS v
      FROM (SELECT grp, image_id, label,
        sum(1 - label) OVER (PARTITION BY grp ORDER BY {side} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          - sum(1 - label) OVER (PARTITION BY grp, {side}) AS cn, sum(1 - label) OVER (PARTITION BY grp, {side}) AS en,
        sum(label) OVER (PARTITION BY grp ORDER BY {side} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          - sum(label) OVER (PARTITION BY grp, {side}) AS cp, sum(label) OVER (PARTITION BY grp, {side}) AS ep,
        sum(1 - label) OVER (PARTITION BY grp) AS nn, sum(label) OVER (PARTITION BY grp) AS np FROM {{pairs}}) q"""


_DELONG = {
    "pair1": """SELECT a.image_id, a.category, a.label, a.anomaly_score AS sa, b.anomaly_score AS sb
      FROM {evt} a JOIN {evt_b} b ON a.image_id = b.image_id WHERE a.anomaly_score IS NOT NULL AND b.anomaly_score IS NOT NULL""",
    "pairs": "SELECT * FROM " + sql_fan("{pair1}") + " f",
    "va": _placed("sa"), "vb": _placed("sb"),
    "dl": """SELECT a.grp AS "group", count(*) AS n, avg(CASE WHEN a.label = 1 THEN a.v END) AS auc_a,
      avg(CASE WHEN a.label = 1 THEN b.v END) AS auc_b,
      var_samp(CASE WHEN a.label = 1 THEN a.v - b.v END) / sum(a.label)
        + var_samp(CASE WHEN a.label = 0 THEN a.v - b.v END) / sum(1 - a.label) AS var
      FROM {va} a JOIN {vb} b ON a.grp = b.grp AND a.image_id = b.image_id GROUP BY a.grp""",
}


@query("b4_delong", """SELECT "group", n, round(auc_a, 9) AS auc_a, round(auc_b, 9) AS auc_b,
  round(auc_a - auc_b, 9) AS delta, round((auc_a - auc_b) / sqrt(var), 6) AS z FROM {dl}""", _DELONG)
def _(v):
    aligned = with_pooled(inference.align_scorers(v("evt"), v("evt_b")))
    out = r9(inference.delong(aligned, ["group"]).drop("p_value"), "auc_a", "auc_b", "delta")
    return out.withColumn("z", F.round("z", 6))


# p-values per customer segment and nation, made from account balances.
_PVAL = {"pv": """SELECT concat(c_mktsegment, '-', CAST(c_nationkey AS STRING)) AS test_id,
  CAST(min(abs(CAST(c_acctbal * 100 AS BIGINT) * 7919) % 100003) AS DOUBLE) / CAST(1000030 AS DOUBLE) AS p
  FROM {customer} GROUP BY 1"""}


@query("b5_holm", """SELECT test_id, p, bool_and(p <= 0.05::DOUBLE / (n - rk + 1)) OVER (ORDER BY rk) AS significant_holm
FROM (SELECT *, row_number() OVER (ORDER BY p, test_id) AS rk, count(*) OVER () AS n FROM {pv}) q""", _PVAL)
def _(v):
    c = v("customer")
    cents = (F.col("c_acctbal") * 100)
    p = F.min(F.abs(F.round(cents).cast("bigint") * 7919) % 100003).cast("double") / 1000030.0
    ids = F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string"))
    pv = c.groupBy(ids.alias("test_id")).agg(p.alias("p"))
    return inference.holm(pv, "p", "test_id")


@query("b6_scorer_comparison", """SELECT "group", 'main' AS scorer_a, 'second' AS scorer_b, n, round(auc_a, 9) AS auc_a,
  round(auc_b, 9) AS auc_b, round(auc_a - auc_b, 9) AS delta FROM {dl}""", _DELONG)
def _(v):
    out = inference.scorer_comparison(v("evt"), v("evt_b"), "main", "second")
    return r9(out.drop("z", "p_value", "significant_holm"), "auc_a", "auc_b", "delta")


# The normal tail by Simpson's rule on 2,000 intervals; p-values round to 9 digits.
_TAIL = """list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
  * exp(-0.5::DOUBLE * (abs(z) * i / 2000) ** 2))) * abs(z) / 6000 * sqrt(2.0::DOUBLE / pi())"""
_SIGNIFICANT = {**_DELONG, "tested": f"""SELECT *, 1.0::DOUBLE - {_TAIL} AS p FROM (SELECT *, (auc_a - auc_b) / sqrt(var) AS z FROM {{dl}}) q""",
                "stepped": """SELECT *, row_number() OVER (ORDER BY coalesce(p, 1), "group") AS rk, count(*) OVER () AS m FROM {tested}"""}


@query("b6_scorer_comparison_significance", """SELECT "group", 'main' AS scorer_a, 'second' AS scorer_b, n, round(auc_a, 9) AS auc_a, round(auc_b, 9) AS auc_b,
  round(auc_a - auc_b, 9) AS delta, round(z, 6) AS z, round(p, 9) AS p_value,
  bool_and(coalesce(p, 1) <= 0.05::DOUBLE / (m - rk + 1)) OVER (ORDER BY rk) AS significant_holm FROM {stepped}""", _SIGNIFICANT)
def _(v):
    out = inference.scorer_comparison(v("evt"), v("evt_b"), "main", "second")
    return r9(out, "auc_a", "auc_b", "delta", "p_value").withColumn("z", F.round("z", 6))


@query("b7_spearman", """SELECT category, count(*) AS n, round(corr(rx, ry), 9) AS rho FROM (
  SELECT category, rank() OVER (PARTITION BY category ORDER BY anomaly_score)
      + (count(*) OVER (PARTITION BY category, anomaly_score) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (PARTITION BY category ORDER BY y) + (count(*) OVER (PARTITION BY category, y) - 1) / 2.0::DOUBLE AS ry
  FROM (SELECT category, anomaly_score, event_no % 13 + label * 3 AS y FROM {evt} WHERE anomaly_score IS NOT NULL) q) r
GROUP BY category""")
def _(v):
    rows = v("evt").withColumn("y", (F.col("event_no") % 13 + F.col("label") * 3).cast("double"))
    return r9(inference.spearman(rows, ["category"], "anomaly_score", "y"), "rho")


@query("b1_bootstrap_auroc", f"""SELECT a.grp AS "group", a.n, a.n_pos, round(a.auroc, 9) AS auroc, round(a.aupr, 9) AS aupr, {_CI_SQL}
FROM {{auc}} a LEFT JOIN {{boot_ci}} c ON c.k = a.grp""", {**_AUC, **stratified_parts("{fan}", ["grp"], "anomaly_score", "label", 500, "boot")})
def _(v):
    return r9(inference.bootstrap_auroc(fanned(v), ["group"], n_boot=500, with_ap=True), "auroc", "aupr", *_CI)


@query("b2_bootstrap_mean", """SELECT category, CAST(m.hits AS BIGINT) AS hits, n, round(m.hits::DOUBLE / n, 9) AS share, round(ci_lo, 9) AS ci_lo, round(ci_hi, 9) AS ci_hi
FROM {means} m JOIN {share_ci} c ON c.hits = m.hits AND c.total = m.n""",
       {"means": "SELECT category, sum(label) AS hits, count(*) AS n FROM {evt} GROUP BY category", **binomial_parts("{means}", "hits", "n", 1000, "share")})
def _(v):
    from surety.operators.conformal import binomial_interval
    out = v("evt").groupBy("category").agg(F.sum("label").alias("hits"),
                                           F.count(F.lit(1)).alias("n"))
    out = out.withColumn("ci", binomial_interval(1000, 0)("hits", "n")).select(
        "category", "hits", "n", (F.col("hits") / F.col("n")).alias("share"),
        F.col("ci.lo").alias("ci_lo"), F.col("ci.hi").alias("ci_hi"))
    return r9(out, "share", "ci_lo", "ci_hi")


_PAIR = {"aligned": """SELECT a.image_id, a.category, a.label, a.anomaly_score AS score_a, b.anomaly_score AS score_b FROM {evt} a JOIN {evt_b} b ON b.image_id = a.image_id""",
         "pairfan": "SELECT * FROM " + sql_fan("{aligned}") + " f",
         "auc_a": sql_auroc("{pairfan}", "grp", "score_a", "label"), "auc_b": sql_auroc("{pairfan}", "grp", "score_b", "label"),
         **paired_parts("{pairfan}", 200, "pb")}


@query("b3_paired_bootstrap", """SELECT a.grp AS "group", round(a.auroc - b.auroc, 9) AS diff, round(d.lo, 9) AS diff_ci_lo, round(d.hi, 9) AS diff_ci_hi, d.p_value
FROM {auc_a} a JOIN {auc_b} b ON b.grp = a.grp LEFT JOIN (SELECT k, quantile_cont(diff, 0.025) AS lo, quantile_cont(diff, 0.975) AS hi,
  least(1.0::DOUBLE, 2.0::DOUBLE * least(avg((diff <= 0)::INT), avg((diff >= 0)::INT))) AS p_value FROM {pb_diff} WHERE diff IS NOT NULL GROUP BY k) d ON d.k = a.grp""", _PAIR)
def _(v):
    aligned = with_pooled(inference.align_scorers(v("evt"), v("evt_b")))
    return r9(inference.paired_bootstrap(aligned, ["group"], n_boot=200), "diff", "diff_ci_lo", "diff_ci_hi")


_METRIC_SQL = {
    **P, "rows_m": "SELECT category, image_id, label, anomaly_score, CAST(correct AS INT) AS correct, round(u_conformal, 12) AS u_conformal FROM {signals}",
    "m_rows": f"""SELECT *, {sql_key('category', 'label')} AS key, row_number() OVER (PARTITION BY category, label ORDER BY image_id) - 1 AS t FROM {{rows_m}}""",
    "m_strata": "SELECT category AS k, label AS cls, count(*) AS n, any_value(key) AS key FROM {m_rows} GROUP BY ALL",
    "m_w": sql_weights("{m_strata}", 20) + " UNION ALL SELECT category, label, 0, t, 1 FROM {m_rows}",
    "m_drawn": "SELECT r.*, rep, w FROM {m_rows} r JOIN {m_w} w ON w.k = r.category AND w.cls = r.label AND w.t = r.t",
    "m_ece": """SELECT category, rep, sum(gap) / sum(n)::DOUBLE AS value FROM (SELECT category, rep, cell, sum(w) AS n, abs(sum(w * label) - sum(w * anomaly_score)) AS gap
      FROM (SELECT *, least(floor(greatest(least(anomaly_score, 1.0::DOUBLE), 0.0::DOUBLE) * 15), 14) AS cell FROM {m_drawn} WHERE anomaly_score IS NOT NULL) q GROUP BY ALL) z GROUP BY ALL""",
    "m_brier": """SELECT category, rep, sum(w * (anomaly_score - label) * (anomaly_score - label)) / sum(w)::DOUBLE AS value FROM {m_drawn} WHERE anomaly_score IS NOT NULL GROUP BY ALL""",
    "m_accuracy": "SELECT category, rep, sum(w * correct) / sum(w)::DOUBLE AS value FROM {m_drawn} GROUP BY ALL",
    "m_copies": """SELECT category, rep, correct, row_number() OVER (PARTITION BY category, rep ORDER BY u, image_id) AS k, sum(1 - correct) OVER (PARTITION BY category, rep ORDER BY u, image_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM (SELECT *, coalesce(u_conformal, 'inf'::DOUBLE) AS u, unnest(range(0, w)) AS copy FROM {m_drawn}) q""",
    "m_aurc": "SELECT category, rep, avg(e::DOUBLE / k) AS value FROM {m_copies} GROUP BY ALL",
    "m_all": " UNION ALL ".join(f"SELECT '{m}' AS metric, * FROM {{m_{m}}}" for m in ("ece", "brier", "accuracy", "aurc")),
}


@query("b1_bootstrap_any_metric", """SELECT category, metric, round(max(CASE WHEN rep = 0 THEN value END), 9) AS value,
  round(quantile_cont(CASE WHEN rep > 0 THEN value END, 0.025), 9) AS ci_lo, round(quantile_cont(CASE WHEN rep > 0 THEN value END, 0.975), 9) AS ci_hi
FROM {m_all} GROUP BY category, metric""", _METRIC_SQL)
def _(v):
    """Calibration error, Brier score, accuracy and risk-coverage area on the same class-stratified replicates."""
    rows = signal_records(v).select("category", "image_id", "label", "anomaly_score", "correct", F.round("u_conformal", 12).alias("u_conformal"))
    wanted = {"ece": bootstrap.ece(), "brier": bootstrap.brier(), "accuracy": bootstrap.coverage("correct"), "aurc": bootstrap.aurc("u_conformal")}
    return r9(bootstrap.bootstrap(rows, ["category"], wanted, n_boot=20), "value", "ci_lo", "ci_hi")
