"""Fusion, shift sweeps, held-out signal choice, the report bundle."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalog.calibration import pool
from catalog.evaluation import SIGNALS, r9, signal_records
from catalog.parts import P, sql_auroc, sql_curve, sql_mode, sql_scored, sql_u01
from catalog.registry import query
from catalog.replicates import stratified_parts
from catalog.tables import scratch
from surety.functions.columns import MODES
from surety.operators import conformal, fusion, report, shift

CONFIG = fusion.FusionConfig(("u_a", "u_conformal"), weights={"u_conformal": 2.0})


def fusion_rows(v):
    """Claims with a consistency and a hallucination column made from their ids."""
    return v("claims").withColumns({
        "cmcs": (F.col("vec_id") * 41) % 307 / F.lit(307.0),
        "halluc": (F.col("vec_id") * 13 + F.col("label")) % 10 < 2})


def _rank(value: str) -> str:
    return (f"(rank() OVER (PARTITION BY category ORDER BY {value}) + (count(*) OVER (PARTITION BY category, {value}) - 1) / 2.0::DOUBLE)"
            f" / count(*) OVER (PARTITION BY category)")


def _log(x: str) -> str:
    return f"ln(least(greatest({x}, 1e-6::DOUBLE), 1.0::DOUBLE))"


FU = {"fr": "SELECT *, (vec_id * 41) % 307 / 307.0::DOUBLE AS cmcs, (vec_id * 13 + label) % 10 < 2 AS halluc FROM {claims}",
      "ff": f"""SELECT *, 1.0::DOUBLE - {_rank('u_a')} AS fa, 1.0::DOUBLE - {_rank('u_conformal')} AS fc, {_rank('cmcs')} AS fm,
        CASE WHEN halluc THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS fh FROM {{fr}}""",
      "ft": f"""SELECT *, fa * fc * fm * fh AS product,
        exp(({_log('fa')} + 2 * {_log('fc')} + {_log('fm')} + {_log('fh')}) / 5.0::DOUBLE) AS wgm,
        exp((2 * {_log('fc')} + {_log('fm')} + {_log('fh')}) / 4.0::DOUBLE) AS no_a,
        exp(({_log('fa')} + {_log('fm')} + {_log('fh')}) / 3.0::DOUBLE) AS no_c,
        exp(({_log('fa')} + 2 * {_log('fc')} + {_log('fh')}) / 4.0::DOUBLE) AS no_m,
        exp(({_log('fa')} + 2 * {_log('fc')} + {_log('fm')}) / 4.0::DOUBLE) AS no_h FROM {{ff}}"""}


@query("f1_trust_factors", """SELECT image_id, round(fa, 9) AS f_u_a, round(fc, 9) AS f_u_conformal, round(fm, 9) AS f_cmcs, fh AS f_halluc FROM {ff}""", FU)
def _(v):
    rows, _present = fusion.factors(fusion_rows(v), CONFIG)
    return r9(rows.select("image_id", "f_u_a", "f_u_conformal", "f_cmcs", "f_halluc"),
              "f_u_a", "f_u_conformal", "f_cmcs")


@query("f2_product_trust", "SELECT image_id, round(product, 9) AS trust_proposal_product FROM {ft}", FU)
def _(v):
    out = fusion.trust_scores(fusion_rows(v), CONFIG)
    return r9(out.select("image_id", "trust_proposal_product"), "trust_proposal_product")


@query("f3_weighted_geometric", "SELECT image_id, round(wgm, 9) AS trust_weighted_geometric FROM {ft}", FU)
def _(v):
    out = fusion.trust_scores(fusion_rows(v), CONFIG)
    return r9(out.select("image_id", "trust_weighted_geometric"), "trust_weighted_geometric")


def newton_parts(source: str, xs: list[str], y: str, steps: int) -> dict[str, str]:
    """Views ``nw0`` to ``nw<steps>`` (``b0``, the intercept, to ``b<n>``): Newton steps from 0, solved by Cholesky factors."""
    xs = ["1.0::DOUBLE", *xs]
    n = len(xs)
    out = {"nw0": "SELECT " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(n))}
    sums = ", ".join([f"sum((p - {y}) * {x}) + max({'0.0' if i == 0 else f'b{i}'}) AS g{i}" for i, x in enumerate(xs)]
                     + [f"sum(p * (1.0::DOUBLE - p) * {xs[i]} * {xs[j]}) + {int(i == j and i > 0)} AS h{i}{j}" for i in range(n) for j in range(i + 1)]
                     + [f"max(b{i}) AS b{i}" for i in range(n)])
    solve = []
    for j in range(n):
        solve.append(f"sqrt(h{j}{j}" + "".join(f" - l{j}{k} * l{j}{k}" for k in range(j)) + f") AS l{j}{j}")
        solve += [f"(h{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + f") / l{j}{j} AS l{i}{j}" for i in range(j + 1, n)]
    solve += [f"(g{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i)) + f") / l{i}{i} AS y{i}" for i in range(n)]
    solve += [f"(y{i}" + "".join(f" - l{k}{i} * d{k}" for k in range(i + 1, n)) + f") / l{i}{i} AS d{i}" for i in reversed(range(n))]
    for t in range(steps):
        z = " + ".join(f"b{i} * {x}" for i, x in enumerate(xs))
        out[f"ns{t}"] = f"SELECT {sums} FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({z}))) AS p FROM {source}, {{nw{t}}}) q"
        solved = f"{{ns{t}}}"
        for k, column in enumerate(solve):  # one column a level, so that no expression is written out twice
            solved = f"(SELECT *, {column} FROM {solved}) q{k}"
        out[f"nw{t + 1}"] = f"SELECT {', '.join(f'b{i} - d{i} AS b{i}' for i in range(n))} FROM {solved}"
    return out


_FACTORS = ["fm", "fh", "fa", "fc"]
_NEWTON = {**FU, **newton_parts("{ff}", _FACTORS, "label", 8),
           "trusted": "SELECT f.*, 1.0::DOUBLE / (1.0::DOUBLE + exp(b0 + " + " + ".join(f"b{i + 1} * {x}" for i, x in enumerate(_FACTORS)) + ")) AS trust FROM {ff} f, {nw8}"}


@query("f4_logistic_trust", "SELECT image_id, round(trust, 6) AS trust FROM {trusted}", _NEWTON)
def _(v):
    rows = fusion_rows(v)
    fitted = fusion.fit_logistic(rows, CONFIG, label="label")
    return fusion.score_logistic(rows, CONFIG, fitted).select("image_id", F.round("trust_logistic", 6).alias("trust"))


def _curves(options: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT image_id, correct, parse_ok, '{name}' AS grp, round({expr}, 12) AS u FROM {{ft}}"
        for name, expr in options.items())


_COMBINE = {**FU, "fl": _curves({
    "proposal_product": "1.0::DOUBLE - product", "weighted_geometric": "1.0::DOUBLE - wgm",
    "single:u_a": "u_a", "single:u_conformal": "u_conformal"}),
    "fcurve": sql_curve("{fl}", "grp", "u")}


@query("f5_combiner_comparison", """SELECT grp AS combiner, round(avg(risk), 6) AS aurc, round(avg(risk) - avg(oracle), 6) AS eaurc, false AS uses_labels,
  round(1.0::DOUBLE - min_by(risk, k) FILTER (coverage >= 0.8::DOUBLE), 6) AS "acc@cov0.8" FROM {fcurve} GROUP BY grp""", _COMBINE)
def _(v):
    out = fusion.compare_combiners(fusion_rows(v), CONFIG).drop("cov@risk0.05")
    return out.select("combiner", F.round("aurc", 6).alias("aurc"),
                      F.round("eaurc", 6).alias("eaurc"), "uses_labels",
                      F.round(F.col("`acc@cov0.8`"), 6).alias("acc@cov0.8"))


_WITH_LOGISTIC = {**_NEWTON, **_COMBINE, "flog": _COMBINE["fl"] + " UNION ALL SELECT t.image_id, t.correct, t.parse_ok, 'logistic(synthetic)' AS grp, round(1.0::DOUBLE - t.trust, 12) AS u FROM {trusted} t",
                  "flcurve": sql_curve("{flog}", "grp", "u")}


@query("f5_combiner_comparison_logistic", """SELECT grp AS combiner, round(avg(risk), 6) AS aurc, round(avg(risk) - avg(oracle), 6) AS eaurc, false AS uses_labels,
  round(1.0::DOUBLE - min_by(risk, k) FILTER (coverage >= 0.8::DOUBLE), 6) AS "acc@cov0.8", round(coalesce(max(coverage) FILTER (risk <= 0.05::DOUBLE), 0), 6) AS "cov@risk0.05"
  FROM {flcurve} GROUP BY grp""", _WITH_LOGISTIC)
def _(v):
    rows = fusion_rows(v)
    out = fusion.compare_combiners(rows, CONFIG, rows.withColumn("synthetic_anomaly", F.col("label")))
    return out.select("combiner", F.round("aurc", 6).alias("aurc"), F.round("eaurc", 6).alias("eaurc"), "uses_labels",
                      *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in ("acc@cov0.8", "cov@risk0.05")])


_DROP = {**FU, "fl": _curves({
    "(none)": "1.0::DOUBLE - wgm", "u_a": "1.0::DOUBLE - no_a", "u_conformal": "1.0::DOUBLE - no_c",
    "cmcs": "1.0::DOUBLE - no_m", "halluc": "1.0::DOUBLE - no_h"}),
    "dcurve": sql_curve("{fl}", "grp", "u"),
    "ds": "SELECT grp, avg(risk) AS aurc, avg(risk) - avg(oracle) AS eaurc FROM {dcurve} GROUP BY grp"}


@query("f6_leave_one_out", """SELECT grp AS dropped, CASE WHEN grp = '(none)' THEN 4 ELSE 3 END AS n_factors, round(aurc, 6) AS aurc, round(eaurc, 6) AS eaurc,
  round(aurc - (SELECT aurc FROM {ds} WHERE grp = '(none)'), 6) AS delta_aurc,
  grp = '(none)' OR aurc > (SELECT aurc FROM {ds} WHERE grp = '(none)') AS justified FROM {ds}""", _DROP)
def _(v):
    out = fusion.leave_one_out(fusion_rows(v), CONFIG)
    return out.withColumns({n: F.round(n, 6) for n in ("aurc", "eaurc", "delta_aurc")})


@query("p21_baseline_mode_guard", """SELECT m.mode, m.mode IN ('symmetric', 'entropy') AS refused, m.mode IN ('symmetric', 'entropy') AND NOT m.allowed AS refused_strictly, n
FROM (SELECT unnest(['symmetric', 'entropy', 'boundary', 'log']) AS mode, false AS allowed) m, (SELECT count(*) AS n FROM {claims}) c""")
def _(v):
    """Every mode is offered to the guard, with and without leave for baseline signals."""
    rows = fusion_rows(v)

    def refused(mode, config):
        try:
            fusion.check_modes(rows.withColumn("conformal_mode", F.lit(mode)), config)
        except ValueError:
            return True
        return False

    allowed = replace(CONFIG, allow_baseline_signals=True)
    table = v.spark.createDataFrame([(m, refused(m, CONFIG), refused(m, CONFIG) and not refused(m, allowed)) for m in MODES],
                                    "mode string, refused boolean, refused_strictly boolean")
    return table.join(rows.agg(F.count(F.lit(1)).alias("n")))


SW = {
    **P,
    "swscored": sql_scored("{sweep}", where="true", extra=", corruption, severity")
    .replace("SELECT image_id, category, label, parse_ok, anomaly_score , corruption, severity, 1 FROM {cal}",
             "SELECT image_id, category, label, parse_ok, anomaly_score, NULL, NULL, 1 FROM {cal}"),
    "swrows": f"SELECT *, {sql_mode('conformal_p', 'log')} AS u_conformal_log, concat(corruption, '|', CAST(severity AS VARCHAR)) AS cell FROM {{swscored}}",
    "swauc": sql_auroc("{swrows}", "cell", "anomaly_score", "label"),
    "swlong": """SELECT image_id, correct, concat(cell, '|u_conformal') AS grp, round(u_conformal, 12) AS u FROM {swrows}
      UNION ALL SELECT image_id, correct, concat(cell, '|u_conformal_log'), round(u_conformal_log, 12) FROM {swrows}""",
    "swcurve": sql_curve("{swlong}", "grp", "u", abstain="false"),
    "swarea": "SELECT grp, avg(risk) AS aurc FROM {swcurve} GROUP BY grp",
    "cells": """SELECT corruption, severity, r.cell, count(*) AS n, max(a.auroc) AS auroc, avg(CAST(correct AS INT)) AS accuracy,
      avg(CASE WHEN label = 0 THEN CASE WHEN anomaly_score IS NOT NULL AND conformal_pred = 0 THEN 1 ELSE 0 END END) AS coverage_on_normals,
      avg(u_conformal) AS mean_u_conformal, avg(u_conformal_log) AS mean_u_conformal_log
      FROM {swrows} r JOIN {swauc} a ON a.cell = r.cell GROUP BY 1, 2, 3""",
}
SWEEP_SIGNALS = ["u_conformal", "u_conformal_log"]


def sweep_table(v):
    rows = shift.calibrate_cells(pool(v), v("sweep"))
    # Rounded like the oracle, so that equal uncertainties tie in both engines.
    rows = conformal.uncertainty_modes(rows, ["log"]).withColumns(
        {u: F.round(u, 12) for u in SWEEP_SIGNALS})
    return shift.evaluate_cells(rows, SWEEP_SIGNALS)


_CELL_COLUMNS = ["auroc", "accuracy", "coverage_on_normals", "mean_u_conformal",
                 "mean_u_conformal_log", "aurc_u_conformal", "aurc_u_conformal_log"]


@query("d1_shift_cells", """SELECT corruption, severity, n, round(auroc, 6) AS auroc, round(accuracy, 6) AS accuracy,
  round(coverage_on_normals, 6) AS coverage_on_normals, round(mean_u_conformal, 6) AS mean_u_conformal, round(mean_u_conformal_log, 6) AS mean_u_conformal_log,
  round(a.aurc, 6) AS aurc_u_conformal, round(b.aurc, 6) AS aurc_u_conformal_log
FROM {cells} c JOIN {swarea} a ON a.grp = concat(c.cell, '|u_conformal') JOIN {swarea} b ON b.grp = concat(c.cell, '|u_conformal_log')""", SW)
def _(v):
    out = sweep_table(v).drop("auroc_ci_lo", "auroc_ci_hi")
    return out.withColumns({c: F.round(c, 6) for c in _CELL_COLUMNS})


SW_CI = {**SW, **stratified_parts("{swrows}", ["corruption", "severity"], "anomaly_score", "label", 100, "swb")}


@query("d1_shift_cells_intervals", """SELECT corruption, severity, n, round(auroc, 6) AS auroc, round(b.auroc_ci_lo, 6) AS auroc_ci_lo, round(b.auroc_ci_hi, 6) AS auroc_ci_hi,
  round(accuracy, 6) AS accuracy, round(coverage_on_normals, 6) AS coverage_on_normals, round(mean_u_conformal, 6) AS mean_u_conformal, round(a.aurc, 6) AS aurc_u_conformal
FROM {cells} c JOIN {swarea} a ON a.grp = concat(c.cell, '|u_conformal') LEFT JOIN {swb_ci} b ON b.k = replace(c.cell, '|', ':')""", SW_CI)
def _(v):
    rows = shift.calibrate_cells(pool(v), v("sweep")).withColumn("u_conformal", F.round("u_conformal", 12))
    out = shift.evaluate_cells(rows, ["u_conformal"], n_boot=100)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("corruption", "severity", "n")})


SW["mono"] = """SELECT corruption, signal, severity, auroc, value FROM (
    SELECT k.corruption, 0 AS severity, c.auroc, c.mean_u_conformal AS a, c.mean_u_conformal_log AS b FROM {cells} c,
      (SELECT DISTINCT corruption FROM {cells} WHERE corruption <> 'none') k WHERE c.corruption = 'none'
    UNION ALL SELECT corruption, severity, auroc, mean_u_conformal, mean_u_conformal_log FROM {cells} WHERE corruption <> 'none') z,
  LATERAL (SELECT unnest(['u_conformal', 'u_conformal_log']) AS signal, unnest([a, b]) AS value) s"""


def _mid(x: str) -> str:
    return (f"rank() OVER (PARTITION BY corruption, signal ORDER BY {x}) + (count(*) OVER (PARTITION BY corruption, signal, {x}) - 1) / 2.0::DOUBLE")


SW["rho"] = f"""SELECT corruption, signal, CASE WHEN count(DISTINCT rv) > 1 THEN corr(rs, rv) END AS ru, CASE WHEN count(DISTINCT ra) > 1 THEN corr(rs, ra) END AS rau,
  max_by(auroc, severity) - min_by(auroc, severity) AS da, max_by(value, severity) - min_by(value, severity) AS du
  FROM (SELECT *, {_mid('severity')} AS rs, {_mid('round(value, 12)')} AS rv, {_mid('round(auroc, 12)')} AS ra FROM {{mono}}) q GROUP BY 1, 2"""


# Adding 0 makes a rounded -0 a plain 0 in both engines.
@query("d2_sweep_monotonicity", """SELECT corruption, signal, round(ru, 6) + 0.0::DOUBLE AS spearman_severity_vs_uncertainty,
  round(rau, 6) + 0.0::DOUBLE AS spearman_severity_vs_auroc, round(da, 6) + 0.0::DOUBLE AS delta_auroc_at_s5,
  round(du, 6) + 0.0::DOUBLE AS delta_uncertainty_at_s5 FROM {rho}""", SW)
def _(v):
    out = shift.monotonicity(rounded_sweep(v), SWEEP_SIGNALS).drop("rho_undefined",
                                                                   "silent_failure")
    return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in out.columns[2:]})


def rounded_sweep(v):
    """Cell means rounded, so that unchanged cells tie exactly."""
    return sweep_table(v).withColumns({c: F.round(c, 12) for c in _CELL_COLUMNS})


@query("d3_silent_failure", """SELECT corruption, signal, ru IS NULL AS rho_undefined, da < -0.02::DOUBLE AND (ru IS NULL OR ru < 0.5) AS silent_failure FROM {rho}""", SW)
def _(v):
    return shift.monotonicity(rounded_sweep(v), SWEEP_SIGNALS).select(
        "corruption", "signal", "rho_undefined", "silent_failure")


@query("w10_scaled_sweep_curves", """SELECT severity, signal, round(value, 6) AS value, round(CASE WHEN hi - lo > 1e-12 THEN (value - lo) / (hi - lo) ELSE 0 END, 6) AS scaled
FROM (SELECT *, min(value) OVER (PARTITION BY signal) AS lo, max(value) OVER (PARTITION BY signal) AS hi FROM (
  SELECT severity, 'u_conformal' AS signal, avg(mean_u_conformal) AS value FROM {cells} WHERE corruption <> 'none' GROUP BY 1
  UNION ALL SELECT severity, 'u_conformal_log', avg(mean_u_conformal_log) FROM {cells} WHERE corruption <> 'none' GROUP BY 1) q) z""", SW)
def _(v):
    out = shift.scaled_curves(sweep_table(v), SWEEP_SIGNALS)
    return out.withColumns({c: F.round(c, 6) for c in ("value", "scaled")})


_HALF = {**P, "halves": f"""SELECT *, CASE WHEN rn <= round_even(0.5::DOUBLE * n, 0) THEN 'select' ELSE 'report' END AS bakeoff_half FROM (
  SELECT *, row_number() OVER (PARTITION BY category, label ORDER BY {sql_u01("'0'", 'image_id')}, image_id) AS rn,
    count(*) OVER (PARTITION BY category, label) AS n FROM {{signals}}) q"""}


def halved(v):
    return report.assign_halves(signal_records(v))


@query("w6_select_report_split", "SELECT image_id, bakeoff_half FROM {halves}", _HALF)
def _(v):
    rows = v("evt").where(F.col("split") == "test")
    return report.assign_halves(rows).select("image_id", "bakeoff_half")


_HALF["half0"] = "SELECT *, 1 - CAST(correct AS INT) AS wrong FROM {halves} WHERE conformal_pred = 0"
_HALF["hlong"] = " UNION ALL ".join(
    f"SELECT concat(bakeoff_half, '|{s}') AS grp, {s} AS value, wrong FROM {{half0}}" for s in SIGNALS)
_HALF["hauc"] = sql_auroc("{hlong}", "grp", "value", "wrong")
_HALF["hs"] = "SELECT split_part(grp, '|', 1) AS half, split_part(grp, '|', 2) AS signal, auroc FROM {hauc}"


@query("w7_winner_selection", """SELECT s.signal AS selected_signal, round(s.auroc, 9) AS select_auroc, round(r.auroc, 9) AS report_auroc, round(s.auroc - r.auroc, 9) AS selection_optimism
FROM (SELECT * FROM {hs} WHERE half = 'select' AND auroc IS NOT NULL ORDER BY auroc DESC, signal DESC LIMIT 1) s JOIN {hs} r ON r.signal = s.signal AND r.half = 'report'""", _HALF)
def _(v):
    table = report.bakeoff(halved(v), SIGNALS, n_boot=0)
    out = report.winner(table).drop("report_ci_lo", "report_ci_hi")
    return r9(out, "select_auroc", "report_auroc", "selection_optimism")


_FLOW_SIGNALS = [("u_conformal",) * 2, ("u_conformal_log",) * 2, ("u_abstention",) * 2,
                 ("BASELINE:score", "anomaly_score"), ("BASELINE:1-score", "-anomaly_score")]
_FLOW = {
    **_HALF,
    "flow_halves": "SELECT *, unnest([bakeoff_half, 'all']) AS half FROM {halves}",
    "flow_long": " UNION ALL ".join(
        f"""SELECT half, '{name}' AS signal, sc.scope, {expr} AS value, 1 - CAST(correct AS INT) AS wrong, concat_ws(':', half, '{name}', sc.scope) AS k
        FROM {{flow_halves}} s, LATERAL (SELECT unnest({"['POOLED', concat('pred=', conformal_pred)" + ("" if name.startswith("BASELINE") else ", category") + "]"}) AS scope) sc"""
        for name, expr in _FLOW_SIGNALS),
    "flow_auc": sql_auroc("{flow_long}", "k", "value", "wrong"),
    **stratified_parts("{flow_long}", ["half", "signal", "scope"], "value", "wrong", 100, "flow"),
    "flow_size": "SELECT half, signal, scope, k, count(*) AS n, CAST(sum(wrong) AS BIGINT) AS n_errors FROM {flow_long} GROUP BY ALL",
    "flow_table": """SELECT z.half, z.signal, z.scope, z.n, z.n_errors, a.auroc, c.auroc_ci_lo AS lo, c.auroc_ci_hi AS hi FROM {flow_size} z
      LEFT JOIN {flow_auc} a ON a.k = z.k LEFT JOIN {flow_ci} c ON c.k = z.k WHERE z.scope = 'POOLED' OR (z.n_errors > 0 AND z.n_errors < z.n)""",
}


def flow(v):
    return report.bakeoff_of_records(v("evt"), ["abstention"], ["log"], n_boot=100)


@query("w7_bakeoff_flow", """SELECT half, signal, scope, n, n_errors, round(auroc, 9) AS err_auroc, round(lo, 9) AS ci_lo, round(hi, 9) AS ci_hi
FROM {flow_table}""", _FLOW)
def _(v):
    out = flow(v).table.select("half", "signal", "scope", "n", "n_errors", "err_auroc", "ci_lo", "ci_hi")
    return r9(out, "err_auroc", "ci_lo", "ci_hi")


@query("w7_bakeoff_flow_winner", """SELECT s.signal AS selected_signal, round(s.auroc, 9) AS select_auroc, round(r.auroc, 9) AS report_auroc,
  round(r.lo, 9) AS report_ci_lo, round(r.hi, 9) AS report_ci_hi, round(s.auroc - r.auroc, 9) AS selection_optimism
FROM (SELECT * FROM {flow_table} WHERE half = 'select' AND scope = 'pred=0' AND signal NOT LIKE 'BASELINE:%' AND auroc IS NOT NULL
      ORDER BY auroc DESC, signal DESC LIMIT 1) s JOIN {flow_table} r ON r.signal = s.signal AND r.half = 'report' AND r.scope = 'pred=0'""", _FLOW)
def _(v):
    return r9(flow(v).winner, "select_auroc", "report_auroc", "report_ci_lo", "report_ci_hi", "selection_optimism")


_FAN = "(SELECT category AS key, * FROM {signals} UNION ALL SELECT 'POOLED', * FROM {signals}) f GROUP BY key"


@query("s17_report_bundle", f"""
SELECT 'abstention' AS table_name, key, count(CASE WHEN NOT parse_ok THEN 1 END)::DOUBLE AS value FROM {_FAN}
UNION ALL SELECT 'calibration', key, round(avg((anomaly_score - label) * (anomaly_score - label)), 9) FROM {_FAN}
UNION ALL SELECT 'detection', key, sum(label)::DOUBLE FROM {_FAN}
UNION ALL SELECT 'detection', 'MEAN_OF_CATEGORIES', sum(label)::DOUBLE FROM {{signals}}
UNION ALL SELECT 'estimators', s, CASE WHEN s IN ('u_abstention', 'u_verdict_var') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM {{five}}
UNION ALL SELECT 'selective', s, n FROM {{five}}, (SELECT count(*)::DOUBLE AS n FROM {{signals}}) c
UNION ALL SELECT 'error_prediction', s, n FROM (SELECT s FROM {{five}} UNION ALL SELECT 'BASELINE:score' UNION ALL SELECT 'BASELINE:1-score') b,
  (SELECT count(CASE WHEN (conformal_pred = 1) <> (label = 1) THEN 1 END)::DOUBLE AS n FROM {{signals}}) c""",
       {**P, "five": "SELECT unnest(['u_abstention', 'u_conformal', 'u_conformal_log', 'u_token_entropy', 'u_verdict_var']) AS s"})
def _(v):
    """The bundle is written as CSV; one column of every table is read back from its files."""
    folder = scratch(v, "report")
    report.build_report(signal_records(v), folder, n_boot=0)
    shown = {"abstention": ("category", "n_abstain"), "calibration": ("group", "brier"), "detection": ("group", "n_anomalous"),
             "estimators": ("signal", "is_baseline"), "selective": ("signal", "n"), "error_prediction": ("signal", "n_errors")}
    out = None
    for name, (key, value) in shown.items():
        table = v.spark.read.option("header", True).csv(f"{folder}/{name}")
        if name == "error_prediction":
            table = table.where("scope = 'POOLED'")
        number = F.col(value).cast("boolean").cast("int") if name == "estimators" else F.round(F.col(value).cast("double"), 9)
        part = table.select(F.lit(name).alias("table_name"), F.col(key).alias("key"), number.cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
