"""Window grids, maps, pixel metrics, grounding and hallucination checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.evaluation import r9
from catalog.parts import sql_auroc, sql_fan
from catalog.registry import query
from catalog.vectors import TAU, V
from surety.functions.text import location_claim
from surety.operators import grounding, maps, pixel
from surety.plans.ranking import with_pooled

OUT = 16

M = {
    **V,
    "wd": "SELECT image_id, category, split, window_idx, x0, y0, embedding::DOUBLE[] AS e FROM {win}",
    "wsim": """SELECT q.image_id, q.window_idx, any_value(q.category) AS category, any_value(q.x0) AS x0, any_value(q.y0) AS y0,
      coalesce(1.0::DOUBLE - max(list_dot_product(q.e, b.e)), 0) AS s
      FROM {wd} q LEFT JOIN {wd} b ON b.category = q.category AND b.window_idx = q.window_idx AND b.split = 'train' GROUP BY 1, 2""",
    "wsim_all": """SELECT image_id, window_idx, 1.0::DOUBLE - avg(sim) AS s FROM (
      SELECT q.image_id, q.window_idx, list_dot_product(q.e, b.e) AS sim, row_number() OVER (PARTITION BY q.image_id, q.window_idx
        ORDER BY list_dot_product(q.e, b.e) DESC) AS rn
      FROM {wd} q JOIN {wd} b ON b.category = q.category AND b.split = 'train') z WHERE rn <= 3 GROUP BY 1, 2""",
    "grid": "SELECT i // 32 AS r, i % 32 AS c FROM (SELECT unnest(range(1024)) AS i) g",
    "painted": """SELECT image_id, category, g.r, g.c, avg(s) AS v FROM {wsim} w JOIN {grid} g
      ON g.c >= x0 AND g.c < x0 + 16 AND g.r >= y0 AND g.r < y0 + 16 GROUP BY 1, 2, 3, 4""",
    # Triangle-filter weights from 32 to 16 pixels.
    "tri": """SELECT o, i, wt / sum(wt) OVER (PARTITION BY o) AS wt FROM (
      SELECT o, i, greatest(0, 1.0::DOUBLE - abs(i + 0.5::DOUBLE - (o + 0.5::DOUBLE) * 2) / 2.0::DOUBLE) AS wt
      FROM (SELECT unnest(range(16)) AS o) a, (SELECT unnest(range(32)) AS i) b) q WHERE wt > 0""",
    "small": """SELECT p.image_id, p.category, a.o AS r, b.o AS c, sum(a.wt * b.wt * p.v) AS v FROM {painted} p
      JOIN {tri} a ON a.i = p.r JOIN {tri} b ON b.i = p.c GROUP BY 1, 2, 3, 4""",
}


def train_windows(v):
    return v("win").where(F.col("split") == "train")


@query("k2_bank_window_scores", "SELECT image_id, window_idx, round(s, 9) AS window_score FROM {wsim}", M)
def _(v):
    out = maps.bank_window_scores(v("win"), train_windows(v))
    return r9(out.select("image_id", F.col("window_idx").cast("bigint").alias("window_idx"),
                         "window_score"), "window_score")


@query("k2_bank_window_scores_global", "SELECT image_id, window_idx, round(s, 9) AS window_score FROM {wsim_all}", M)
def _(v):
    out = maps.bank_window_scores(v("win"), train_windows(v), k=3, positional=False)
    return r9(out.select("image_id", F.col("window_idx").cast("bigint").alias("window_idx"),
                         "window_score"), "window_score")


@query("j7_windows_vs_bank", """SELECT category, window_idx, round(avg(s), 9) AS mean_score FROM {wsim} GROUP BY 1, 2""", M)
def _(v):
    out = maps.bank_window_scores(v("win"), train_windows(v))
    return out.groupBy("category", F.col("window_idx").cast("bigint").alias("window_idx")).agg(
        F.round(F.avg("window_score"), 9).alias("mean_score"))


# Text vectors of a window's length: all 64 numbers, folded onto 16 by adding.
_FOLD = ("SELECT category, polarity, template_idx, list_transform(range(1, 17), lambda j: embedding[j]::DOUBLE + embedding[j + 16] + embedding[j + 32]"
         " + embedding[j + 48]) AS embedding FROM {txt}")
T16 = {**M, "txt16": _FOLD, "tm16": V["tmean"].replace("{txt}", "{txt16}"),
       "tsim": f"""SELECT w.image_id, w.category, w.window_idx, w.x0, w.y0,
         1.0::DOUBLE / (1.0::DOUBLE + exp(-(list_dot_product(w.e, a.e) - list_dot_product(w.e, n.e)) / {TAU}::DOUBLE)) AS s
         FROM {{wd}} w JOIN {{tm16}} n ON n.category = w.category AND n.polarity = 'normal'
         JOIN {{tm16}} a ON a.category = w.category AND a.polarity = 'anomaly'"""}
T16["tpainted"] = M["painted"].replace("{wsim}", "{tsim}")
T16["tsmall"] = M["small"].replace("{painted}", "{tpainted}")


def window_text(v):
    e = F.col("embedding")
    return v("txt").withColumn("embedding", F.transform(F.sequence(F.lit(1), F.lit(16)), lambda j: sum(
        (F.element_at(e, j + 16 * k).cast("double") for k in (1, 2, 3)), F.element_at(e, j).cast("double"))))


@query("k3_text_window_scores", "SELECT image_id, window_idx, round(s, 9) AS window_score FROM {tsim}", T16)
def _(v):
    out = maps.text_window_scores(v("win"), window_text(v), TAU)
    return r9(out.select("image_id", F.col("window_idx").cast("bigint").alias("window_idx"),
                         "window_score"), "window_score")


@query("k4_window_grid", """
WITH sizes AS (SELECT p_partkey, 32 + 16 * p_size AS size FROM {part}),
 s AS (SELECT *, greatest(CAST(round_even(size * f, 0) AS INT), 16) AS w FROM sizes, (SELECT unnest([0.5::DOUBLE, 0.3333::DOUBLE]) AS f) z),
 t AS (SELECT p_partkey, f, size, w, list_distinct(list_append(range(0, size - w + 1, greatest(CAST(round_even(w * 0.5::DOUBLE, 0) AS INT), 1)), size - w)) AS tops FROM s),
 u AS (SELECT p_partkey, f, w, unnest(tops) AS t, tops FROM t), x AS (SELECT p_partkey, f, w, t, unnest(tops) AS l FROM u)
SELECT p_partkey, CAST(l AS INT) AS l, CAST(t AS INT) AS t, CAST(l + w AS INT) AS r, CAST(t + w AS INT) AS b FROM x""")
def _(v):
    sizes = v("part").select("p_partkey", (32 + 16 * F.col("p_size")).alias("size"))
    return maps.window_grid(sizes).select("p_partkey", "box.l", "box.t", "box.r", "box.b")


@query("k5_paint", """SELECT image_id, list(round(v, 9) ORDER BY r, c) AS values FROM {painted} GROUP BY image_id""", M)
def _(v):
    out = maps.paint(maps.bank_window_scores(v("win"), train_windows(v)), 32)
    return out.select("image_id", F.transform("values", lambda x: F.round(x, 9)).alias("values"))


@query("j8_windows_vs_pixels", """SELECT image_id, count(*) AS n_pixels, round(sum(v), 6) AS total FROM {painted} GROUP BY image_id""", M)
def _(v):
    out = maps.paint(maps.bank_window_scores(v("win"), train_windows(v)), 32)
    return out.select("image_id", F.size("values").cast("bigint").alias("n_pixels"),
                      F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6)
                      .alias("total"))


@query("k6_resample_map", """SELECT image_id, list(round(v, 9) ORDER BY r, c) AS values FROM {small} GROUP BY image_id""", M)
def _(v):
    painted = maps.paint(maps.bank_window_scores(v("win"), train_windows(v)), 32)
    out = maps.resize_maps(painted, OUT)
    return out.select("image_id", F.transform("values", lambda x: F.round(x, 9)).alias("values"))


@query("k7_map_stage", """
SELECT category, 'bank' AS map_kind, count(DISTINCT image_id) AS n_maps, round(avg(v), 9) AS mean_value FROM {small} GROUP BY category
UNION ALL SELECT category, 'text', count(DISTINCT image_id), round(avg(v), 9) FROM {tsmall} GROUP BY category""", T16)
def _(v):
    out = maps.build_maps(v("win"), train_windows(v), window_text(v), 32, OUT, tau=TAU)
    cells = out.select("category", "map_kind", "image_id", F.explode("values").alias("v"))
    return cells.groupBy("category", "map_kind").agg(
        F.countDistinct("image_id").alias("n_maps"), F.round(F.avg("v"), 9).alias("mean_value"))


@query("k7_map_stage_kinds", f"""
SELECT image_id, 'bank' AS map_kind, {OUT} AS h, {OUT} AS w, round(max(v), 9) AS top FROM {{small}} GROUP BY image_id
UNION ALL SELECT image_id, 'text', {OUT}, {OUT}, round(max(v), 9) FROM {{tsmall}} GROUP BY image_id""", T16)
def _(v):
    out = maps.build_maps(v("win"), train_windows(v), window_text(v), 32, OUT, tau=TAU)
    return out.select("image_id", "map_kind", "h", "w", F.round(F.array_max("values"), 9).alias("top"))


X = {
    "bankpix": "SELECT image_id, category, label, vec_id, r, c, i, m, vb AS v FROM {pix}",
    "att": """SELECT *, v >= min(v) FILTER (rn <= 51) OVER (PARTITION BY image_id) AS seen FROM (
      SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v DESC) AS rn FROM {bankpix}) q""",
    "evidence": "SELECT image_id, quantile_cont(v, 0.99) AS spatial FROM {bankpix} GROUP BY image_id",
    "bands": """SELECT c.*, kind, r0, r1, c0, c1, kind IN ('corner', 'quadrant', 'edge') AS loc FROM {claims} c JOIN (VALUES
      (0, 'corner', 0, 14, 0, 14), (1, 'quadrant', 0, 14, 18, 32), (2, 'edge', 0, 32, 0, 32), (3, 'surface', 0, 32, 0, 32),
      (4, 'quadrant', 9, 23, 9, 23), (5, 'none', 0, 32, 0, 32), (6, 'unparsed', 0, 32, 0, 32), (7, 'quadrant', 18, 32, 0, 32))
      b(k, kind, r0, r1, c0, c1) ON b.k = c.vec_id % 8""",
    "claimreg": """SELECT b.image_id, b.category, b.label, b.conformal_pred, b.anomaly_score, b.kind, b.loc, a.v, a.m, a.seen,
      CASE WHEN NOT b.loc THEN true WHEN b.kind = 'edge' THEN a.r < 6 OR a.r >= 26 OR a.c < 6 OR a.c >= 26
        ELSE a.r >= b.r0 AND a.r < b.r1 AND a.c >= b.c0 AND a.c < b.c1 END AS inside
      FROM {bands} b JOIN {att} a ON a.image_id = b.image_id""",
    "ground": """SELECT image_id, any_value(category) AS category, any_value(anomaly_score) AS anomaly_score, any_value(kind) AS claim_kind,
      any_value(loc) AS claim_localized, count(CASE WHEN inside AND seen THEN 1 END)::DOUBLE / nullif(count(CASE WHEN inside OR seen THEN 1 END), 0) AS claim_iou,
      avg(CASE WHEN inside THEN v END) AS claim_inside_mean, avg(CASE WHEN NOT inside THEN v END) AS claim_outside_mean FROM {claimreg} GROUP BY image_id""",
}


def bank_maps(v):
    return v("maps").where(F.col("map_kind") == "bank").select("image_id", "category", "label",
                                                               "h", "w", "values")


@query("p23_location_claim", """SELECT image_id, kind, r0 / 32.0::DOUBLE < 0.5::DOUBLE AS starts_high, loc AS is_localized FROM {bands}""", X)
def _(v):
    rows = v("claims").withColumn("c", location_claim(F.col("predicted_location")))
    return rows.select("image_id", F.col("c.kind").alias("kind"),
                       (F.col("c.r0") < 0.5).alias("starts_high"),
                       F.col("c.is_localized").alias("is_localized"))


@query("w8_attended_region", """SELECT image_id, count(CASE WHEN seen THEN 1 END) AS n_seen, round(min(CASE WHEN seen THEN v END), 9) AS cut FROM {att} GROUP BY image_id""", X)
def _(v):
    seen = grounding.attended_region(F.col("values"))
    kept = F.filter(F.zip_with("values", seen, lambda x, s: F.when(s, x)),
                    lambda x: x.isNotNull())
    return bank_maps(v).select("image_id", F.size(kept).cast("bigint").alias("n_seen"),
                               F.round(F.array_min(kept), 9).alias("cut"))


@query("w9_spatial_evidence", "SELECT image_id, round(spatial, 9) AS spatial_score FROM {evidence}", X)
def _(v):
    return bank_maps(v).select("image_id", F.round(
        grounding.spatial_evidence(F.col("values")), 9).alias("spatial_score"))


@query("h1_claim_mask", """SELECT image_id, count(CASE WHEN CASE kind WHEN 'none' THEN false WHEN 'edge' THEN r < 6 OR r >= 26 OR c < 6 OR c >= 26
  ELSE r >= r0 AND r < r1 AND c >= c0 AND c < c1 END THEN 1 END) AS n_covered
FROM {bands} b, (SELECT i // 32 AS r, i % 32 AS c FROM (SELECT unnest(range(1024)) AS i) z) g GROUP BY image_id""", X)
def _(v):
    rows = v("claims").withColumn("c", location_claim(F.col("predicted_location"))).withColumn(
        "grid", F.sequence(F.lit(0), F.lit(1023)))
    mask = grounding.claim_mask(F.col("c"), F.col("grid"), F.lit(32))
    return rows.select("image_id", grounding.count_true(mask).cast("bigint").alias("n_covered"))


@query("h2_region_iou", """SELECT image_id, round(coalesce(count(CASE WHEN seen AND m = 1 THEN 1 END)::DOUBLE / nullif(count(CASE WHEN seen OR m = 1 THEN 1 END), 0), 0), 9) AS iou
FROM {att} GROUP BY image_id""", X)
def _(v):
    rows = pixel.with_masks(bank_maps(v), v("masks"))
    iou = grounding.region_iou(grounding.attended_region(F.col("values")),
                               F.transform("mask", lambda m: m > 0))
    return rows.select("image_id", F.round(iou, 9).alias("iou"))


@query("h3_claim_grounding", """SELECT image_id, claim_kind, claim_localized, round(claim_iou, 9) AS claim_iou, round(claim_inside_mean, 9) AS claim_inside_mean,
  round(claim_outside_mean, 9) AS claim_outside_mean, round(claim_inside_mean / claim_outside_mean, 9) AS claim_contrast FROM {ground}""", X)
def _(v):
    rows = v("claims").join(bank_maps(v).select("image_id", "h", "values"), "image_id", "left")
    names = ["claim_iou", "claim_inside_mean", "claim_outside_mean", "claim_contrast"]
    return r9(grounding.claim_grounding(rows).select(
        "image_id", "claim_kind", "claim_localized", *names), *names)


def _rank(value: str, part: str = "category") -> str:
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {value}) + (count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2.0::DOUBLE)"
            f" / count(*) OVER (PARTITION BY {part})")


X["ranks"] = f"""SELECT g.*, {_rank('anomaly_score')} AS rs, {_rank('round(e.spatial, 12)')} AS rm FROM {{ground}} g JOIN {{evidence}} e ON e.image_id = g.image_id"""
X["contrast"] = f"""SELECT image_id, {_rank('round(x, 12)')} AS rc FROM (SELECT image_id, category,
  claim_inside_mean / claim_outside_mean AS x FROM {{ground}}) q WHERE x IS NOT NULL"""
X["cm"] = """SELECT r.image_id, r.category, 1.0::DOUBLE - abs(rs - rm) AS global_cmcs,
  0.5::DOUBLE * coalesce(c.rc, 0.5::DOUBLE) + 0.5::DOUBLE * (1.0::DOUBLE - abs(rs - rm)) AS cmcs
  FROM {ranks} r LEFT JOIN {contrast} c ON c.image_id = r.image_id"""


@query("h4_cmcs_global", "SELECT image_id, round(global_cmcs, 9) AS cmcs FROM {cm}", X)
def _(v):
    out = grounding.cmcs(v("claims"), bank_maps(v), "global_spatial")
    return r9(out.select("image_id", "cmcs"), "cmcs")


@query("h5_cmcs_language", "SELECT image_id, round(cmcs, 9) AS cmcs FROM {cm}", X)
def _(v):
    out = grounding.cmcs(v("claims"), bank_maps(v))
    return r9(out.select("image_id", "cmcs"), "cmcs")


@query("h6_cmcs_literal", """SELECT c.image_id, round(1.0::DOUBLE - abs(c.anomaly_score - e.spatial), 9) AS cmcs_literal
FROM {claims} c JOIN {evidence} e ON e.image_id = c.image_id""", X)
def _(v):
    out = grounding.cmcs_literal(v("claims"), bank_maps(v))
    return r9(out.select("image_id", "cmcs_literal"), "cmcs_literal")


@query("m14_cmcs_summary", """SELECT m.category, round(avg(m.cmcs), 9) AS mean_cmcs, round(avg(CASE WHEN c.label = 0 THEN m.cmcs END), 9) AS mean_cmcs_normal,
  round(avg(CASE WHEN c.label = 1 THEN m.cmcs END), 9) AS mean_cmcs_anomalous FROM {cm} m JOIN {claims} c ON c.image_id = m.image_id GROUP BY m.category""", X)
def _(v):
    out = grounding.cmcs_summary(grounding.cmcs(v("claims"), bank_maps(v)))
    return r9(out, "mean_cmcs", "mean_cmcs_normal", "mean_cmcs_anomalous")


# Consistency made from plain columns, for the threshold and attenuation queries.
_FLAG = {"fl": """SELECT image_id, category, label, anomaly_score, (vec_id * 41) % 307 / 307.0::DOUBLE AS cmcs FROM {claims}""",
         "th": """SELECT category, quantile_cont(cmcs, 0.1) AS theta_cmcs, quantile_cont(anomaly_score, 0.9) AS theta_anom FROM {fl} WHERE label = 0 GROUP BY category"""}


def flag_rows(v):
    return v("claims").select("image_id", "category", "label", "anomaly_score",
                              ((F.col("vec_id") * 41) % 307 / F.lit(307.0)).alias("cmcs"))


@query("c16_flag_thresholds", "SELECT category, round(theta_cmcs, 9) AS theta_cmcs, round(theta_anom, 9) AS theta_anom FROM {th}", _FLAG)
def _(v):
    out = grounding.flag_thresholds(flag_rows(v).where(F.col("label") == 0))
    return r9(out, "theta_cmcs", "theta_anom")


@query("p22_attenuated_score", """SELECT f.image_id, coalesce(cmcs < theta_cmcs AND anomaly_score > theta_anom, false) AS halluc_flag_eq4,
  round(CASE WHEN cmcs < theta_cmcs AND anomaly_score > theta_anom THEN anomaly_score * pow(greatest(cmcs, 1e-9::DOUBLE), 1.5::DOUBLE) ELSE anomaly_score END, 9) AS s_adj
FROM {fl} f JOIN {th} t ON t.category = f.category""", _FLAG)
def _(v):
    rows = flag_rows(v)
    out = grounding.attenuate(rows, grounding.flag_thresholds(rows.where(F.col("label") == 0)))
    return r9(out.select("image_id", "halluc_flag_eq4", "s_adj"), "s_adj")


X["flags"] = """SELECT image_id, category, label, conformal_pred, iou,
  CASE WHEN conformal_pred = 0 THEN 'none' WHEN label = 0 THEN 'a_positive_on_good' WHEN iou < 0.05::DOUBLE THEN 'b_wrong_region' ELSE 'grounded' END AS halluc_case
  FROM (SELECT image_id, any_value(category) AS category, any_value(label) AS label, any_value(conformal_pred) AS conformal_pred,
    count(CASE WHEN reg AND m = 1 THEN 1 END)::DOUBLE / nullif(count(CASE WHEN reg OR m = 1 THEN 1 END), 0) AS iou
    FROM (SELECT *, CASE WHEN loc THEN inside ELSE seen END AS reg FROM {claimreg}) q GROUP BY image_id) z"""
X["ffan"] = "SELECT * FROM " + sql_fan("{flags}") + " f"
_RATE = """count(CASE WHEN halluc_case <> 'none' THEN 1 END) AS n_positive,
  round(count(CASE WHEN halluc_case IN ('a_positive_on_good', 'b_wrong_region') THEN 1 END)::DOUBLE / nullif(count(CASE WHEN halluc_case <> 'none' THEN 1 END), 0), 9) AS hr,
  round(count(CASE WHEN halluc_case = 'a_positive_on_good' THEN 1 END)::DOUBLE / nullif(count(CASE WHEN halluc_case <> 'none' THEN 1 END), 0), 9) AS hr_case_a,
  round(count(CASE WHEN halluc_case = 'b_wrong_region' THEN 1 END)::DOUBLE / nullif(count(CASE WHEN halluc_case <> 'none' THEN 1 END), 0), 9) AS hr_case_b"""


def flagged(v):
    return grounding.hallucination_flags(v("claims"), bank_maps(v), v("masks"))


@query("h7_hallucination_flags", """SELECT image_id, halluc_case, halluc_case IN ('a_positive_on_good', 'b_wrong_region') AS halluc,
  CASE WHEN conformal_pred = 1 THEN CASE WHEN label = 0 THEN 0 ELSE round(iou, 9) END END AS gt_iou FROM {flags}""", X)
def _(v):
    return r9(flagged(v).select("image_id", "halluc_case", "halluc", "gt_iou"), "gt_iou")


@query("h8_hallucination_rate", f"""SELECT grp AS "group", count(*) AS n, {_RATE}, count(CASE WHEN halluc_case = 'unverifiable' THEN 1 END) AS n_unverifiable
FROM {{ffan}} GROUP BY grp""", X)
def _(v):
    return r9(grounding.hallucination_rate(flagged(v)), "hr", "hr_case_a", "hr_case_b")


@query("h9_iou_sensitivity", f"""SELECT t AS iou_threshold, {_RATE} FROM (
  SELECT t, CASE WHEN conformal_pred = 0 THEN 'none' WHEN label = 0 THEN 'a_positive_on_good' WHEN iou < t THEN 'b_wrong_region' ELSE 'grounded' END AS halluc_case
  FROM {{flags}}, (SELECT unnest([0.0, 0.01, 0.05, 0.1, 0.2, 0.3]::DOUBLE[]) AS t) g) q GROUP BY t""", X)
def _(v):
    return r9(grounding.iou_sensitivity(flagged(v)), "hr", "hr_case_a", "hr_case_b")


PX = {"kinds": "SELECT image_id, category, label, vec_id, i, m, 'bank' AS map_kind, vb AS v FROM {pix} UNION ALL SELECT image_id, category, label, vec_id, i, m, 'text', vt FROM {pix}",
      "pfan": "SELECT concat(map_kind, '|', grp) AS k, map_kind, grp, image_id, i, m, v FROM " + sql_fan("{kinds}") + " f",
      "pauc": sql_auroc("{pfan}", "k", "v", "m"),
      # The regions of these masks are the large block and the 2 x 2 block in the corner.
      "reg": "SELECT *, CASE WHEN m = 0 THEN 0 WHEN i >= 29 * 32 THEN 2 ELSE 1 END AS region FROM {pfan}",
      "rng": "SELECT k, max(v) AS hi, min(v) AS lo FROM {pfan} GROUP BY k",
      "thr": "SELECT k, j, CASE WHEN j = 199 THEN lo ELSE hi + j * ((lo - hi) / 199.0::DOUBLE) END AS t FROM {rng}, (SELECT unnest(range(200)) AS j) z",
      "hist": "SELECT k, image_id, region, v, count(*) AS c FROM {reg} GROUP BY 1, 2, 3, 4",
      "distinctv": "SELECT DISTINCT k, v FROM {hist}",
      "vb": "SELECT d.k, d.v, min(t.j) AS j FROM {distinctv} d JOIN {thr} t ON t.k = d.k AND d.v >= t.t GROUP BY 1, 2",
      "share": """SELECT k, j, sum(CASE WHEN region > 0 THEN c::DOUBLE / size ELSE 0 END) AS sh, sum(CASE WHEN region = 0 THEN c ELSE 0 END) AS nc
        FROM (SELECT h.*, b.j, sum(h.c) OVER (PARTITION BY h.k, h.image_id, h.region) AS size FROM {hist} h JOIN {vb} b ON b.k = h.k AND b.v = h.v) q GROUP BY 1, 2""",
      "procurve": """SELECT k, j, sum(nc) OVER w / sum(nc) OVER (PARTITION BY k)::DOUBLE AS fpr, sum(sh) OVER w / round(sum(sh) OVER (PARTITION BY k)) AS pro
        FROM {share} WINDOW w AS (PARTITION BY k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
      "prov": """SELECT k, (coalesce(sum(area), 0) + CASE WHEN max(fpr) < 0.3::DOUBLE THEN (0.3::DOUBLE - max(fpr)) * max(pro) ELSE 0 END) / 0.3::DOUBLE AS pro
        FROM (SELECT k, fpr, pro, (fpr - lag(fpr) OVER (PARTITION BY k ORDER BY j)) * (pro + lag(pro) OVER (PARTITION BY k ORDER BY j)) / 2.0::DOUBLE AS area
          FROM {procurve} WHERE fpr <= 0.3::DOUBLE) q GROUP BY k"""}


def pixel_rows(v):
    rows = pixel.regions(pixel.with_masks(v("maps"), v("masks")))
    return with_pooled(rows)


@query("m19_pixel_auroc", """SELECT split_part(k, '|', 1) AS map_kind, split_part(k, '|', 2) AS "group", n AS n_pixels, round(auroc, 9) AS pixel_auroc FROM {pauc}""", PX)
def _(v):
    rows = pixel.with_masks(v("maps"), v("masks"))
    return r9(pixel.pixel_auroc(rows, ["map_kind"], "category"), "pixel_auroc")


@query("m20_pro", """SELECT split_part(k, '|', 1) AS map_kind, split_part(k, '|', 2) AS "group", round(pro, 9) AS pro FROM {prov}""", PX)
def _(v):
    return r9(pixel.pro_score(pixel_rows(v), ["map_kind", "group"]), "pro")


@query("m20_pro_curve", """SELECT split_part(k, '|', 1) AS map_kind, split_part(k, '|', 2) AS "group", CAST(j AS INT) AS threshold_idx, round(fpr, 9) AS fpr, round(pro, 9) AS pro FROM {procurve}""", PX)
def _(v):
    return r9(pixel.pro_curve(pixel_rows(v), ["map_kind", "group"]), "fpr", "pro")


@query("m21_connected_regions", """
SELECT image_id, CAST(anchor AS INT) AS anchor, count(*) AS n_pixels FROM (SELECT image_id, cell, min(start) AS anchor FROM {reach} GROUP BY 1, 2) q GROUP BY 1, 2""",
       {"mcells": "SELECT image_id, CAST(i AS BIGINT) AS i FROM {pix} WHERE m = 1",
        "steps": """SELECT a.image_id, a.i AS a, b.i AS b FROM {mcells} a JOIN {mcells} b ON b.image_id = a.image_id
          AND (abs(a.i - b.i) = 32 OR (abs(a.i - b.i) = 1 AND a.i // 32 = b.i // 32))""",
        # Reachability from every pixel; UNION drops what is already known.
        "reach": """SELECT image_id, i AS start, i AS cell FROM {mcells} UNION
          SELECT r.image_id, r.start, s.b FROM {reach} r JOIN {steps} s ON s.image_id = r.image_id AND s.a = r.cell"""},
       recursive=True)
def _(v):
    return pixel.region_sizes(v("masks")).select("image_id", "anchor", "n_pixels")


@query("m22_pixel_table", """SELECT split_part(a.k, '|', 1) AS map_kind, split_part(a.k, '|', 2) AS category, n.n, round(a.auroc, 9) AS pixel_auroc, round(p.pro, 9) AS pro
FROM {pauc} a JOIN (SELECT k, count(DISTINCT image_id) AS n FROM {pfan} GROUP BY k) n ON n.k = a.k LEFT JOIN {prov} p ON p.k = a.k""", PX)
def _(v):
    return r9(pixel.pixel_table(v("maps"), v("masks")), "pixel_auroc", "pro")
