"""Index, records, stores and small projections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.calibration import scored
from catalog.parts import P, sql_auroc, sql_u01
from catalog.registry import query
from surety.functions.columns import CONFIDENCE, raw_logit
from surety.functions.text import canonical_defect, class_name
from surety.operators import browse, grounding, signals
from surety.session import checkpoint_dir
from surety.sources import index, records, stores


def scratch(v, name: str) -> str:
    """A fresh folder beside the session's checkpoints, visible to all executors."""
    return f"{checkpoint_dir(v.spark)}/surety-{name}-{uuid.uuid4().hex}"


_STEM = "regexp_replace(split_part(path, '/', 6), '\\.[^.]*$', '')"
_INDEX = {
    "parts": f"""SELECT path, split_part(path, '/', 3) AS category, split_part(path, '/', 4) AS split,
      split_part(path, '/', 5) AS defect_type, {_STEM} AS stem, regexp_extract(path, '(\\.[^./]*)$', 1) AS suffix
      FROM {{paths}}""",
    "mparts": f"""SELECT path, split_part(path, '/', 3) AS category, split_part(path, '/', 5) AS defect_type,
      split_part(path, '/', 6) AS file FROM {{maskpaths}}""",
    "idx": """SELECT *, CASE WHEN defect_type = 'good' THEN 0 ELSE 1 END AS label,
      concat(category, '/', split, '/', defect_type, '/', stem) AS image_id
      FROM {parts} WHERE suffix IN ('.png', '.jpg', '.jpeg', '.JPG', '.PNG', '.bmp')""",
    "chosen": """SELECT i.image_id, min(CASE WHEN m.file = i.stem || '_mask.png' THEN '0' WHEN m.file = i.stem || '.png' THEN '1'
        ELSE '2' END || m.path) AS best
      FROM {idx} i JOIN {mparts} m ON m.category = i.category AND m.defect_type = i.defect_type
        AND m.file IN (i.stem || '_mask.png', i.stem || '.png', i.stem || '_mask' || i.suffix)
      WHERE i.label = 1 GROUP BY i.image_id""",
}


@query("s1_build_index", """
SELECT i.category, i.split, i.defect_type, i.path, i.label, coalesce(substr(c.best, 2), '') AS mask_path, i.image_id
FROM {idx} i LEFT JOIN {chosen} c ON c.image_id = i.image_id""", _INDEX)
def _(v):
    return index.build_index(v("paths"), v("maskpaths"))


@query("s2_available_categories", "SELECT DISTINCT category FROM {parts} WHERE split = 'test'", _INDEX)
def _(v):
    return index.available_categories(v("paths"))


@query("s3_mask_association", "SELECT image_id, substr(best, 2) AS mask_path FROM {chosen}", _INDEX)
def _(v):
    out = index.build_index(v("paths"), v("maskpaths"))
    return out.where(F.col("mask_path") != "").select("image_id", "mask_path")


@query("s4_subset_per_folder", f"""
SELECT image_id, split FROM (SELECT *, row_number() OVER (PARTITION BY category, split, defect_type
  ORDER BY {sql_u01("'42'", 'category', 'split', 'defect_type', 'image_id')}, image_id) AS rn FROM {{idx}}) q
WHERE rn <= CASE WHEN split = 'test' THEN 20 ELSE 50 END""", _INDEX)
def _(v):
    out = index.build_index(v("paths"), test_per_folder=20,
                            other_per_folder=50)
    return out.select("image_id", "split")


RUN = {"run_id": "r1", "scorer_name": "main", "model_id": "m1", "subset_tag": "full",
       "corruption": "none", "severity": 0}
_CORE = """SELECT 'r1' AS run_id, 'main' AS scorer_name, 'm1' AS model_id, category, '' AS defect_type, '' AS path,
  image_id, CAST(label AS BIGINT) AS label, split, 'full' AS subset_tag, 'none' AS corruption, CAST(0 AS BIGINT) AS severity,
  anomaly_score, CAST(NULL AS DOUBLE) AS raw_score, parse_ok, CAST(1 AS BIGINT) AS n_valid_votes FROM {evt}"""


def core(v):
    return records.finalize(v("evt").drop("event_no"), RUN)


@query("s5_read_records", _CORE)
def _(v):
    folder = scratch(v, "records")
    rows = core(v)
    records.write_records(rows.where(F.col("label") == 0), f"{folder}/normal")
    records.write_records(rows.where(F.col("label") == 1), f"{folder}/anomalous.csv")
    out = records.read_records(v.spark, [f"{folder}/normal", f"{folder}/anomalous.csv"])
    # CSV has no empty strings of its own: they are read back as NULL.
    return out.na.fill("", ["defect_type", "path"])


@query("s6_write_records", f"SELECT category, split, count(*) AS n FROM ({_CORE}) q GROUP BY 1, 2")
def _(v):
    path = records.write_records(core(v), f"{scratch(v, 'written')}/records")
    return v.spark.read.parquet(path).groupBy("category", "split").agg(
        F.count(F.lit(1)).alias("n"))


@query("s7_validate_records", """
SELECT * FROM (
  SELECT 'label must be 0 or 1' AS rule, count(CASE WHEN event_no % 97 = 0 THEN 1 END) AS n FROM {evt}
  UNION ALL SELECT 'score outside [0, 1]', count(CASE WHEN parse_ok AND event_no % 89 = 0 THEN 1 END) FROM {evt}
  UNION ALL SELECT 'duplicate key', count(CASE WHEN event_no % 101 = 0 THEN 1 END) FROM {evt}) q WHERE n > 0""")
def _(v):
    rows = v("evt").withColumns({
        "label": F.when(F.col("event_no") % 97 == 0, F.lit(7)).otherwise(F.col("label")),
        "anomaly_score": F.when(F.col("parse_ok") & (F.col("event_no") % 89 == 0),
                                F.lit(1.5)).otherwise(F.col("anomaly_score"))})
    # Every 101st row twice, without breaking the other two rules again.
    again = v("evt").where(F.col("event_no") % 101 == 0)
    return records.violations(records.finalize(rows, RUN).unionByName(
        records.finalize(again, RUN)).drop("event_no"))


@query("s8_empty_records", f"SELECT split, count(*) AS n FROM ({_CORE}) q GROUP BY 1")
def _(v):
    """The empty frame takes part in a concatenation and adds nothing."""
    return records.empty_records(v.spark).unionByName(
        core(v), allowMissingColumns=True).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("s9_signals_long", """
SELECT signal, count(value) AS n, round(avg(value), 9) AS mean FROM (
  SELECT 'u_abstention' AS signal, u_abstention AS value FROM {signals} UNION ALL
  SELECT 'u_conformal', u_conformal FROM {signals} UNION ALL
  SELECT 'u_verdict_var', u_verdict_var FROM {signals}) q GROUP BY signal""", P)
def _(v):
    rows = signals.attach_signals(scored(v), ["abstention", "verdict_var"])
    return records.signals_long(rows, ["image_id"]).groupBy("signal").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 9).alias("mean"))


@query("s10_finalize", _CORE)
def _(v):
    return core(v)


@query("s11_embedding_store", "SELECT image_id, len(embedding) AS dim FROM {emb} WHERE category = 'c1' AND split = 'test'")
def _(v):
    store = stores.EmbeddingStore(v.spark, scratch(v, "embeddings"))
    store.save(v("emb").select("image_id", "embedding", "category", "split"), model_tag="m",
               kind="image")
    return store.load(model_tag="m", category="c1", split="test", kind="image").select(
        "image_id", F.size("embedding").cast("bigint").alias("dim"))


@query("s12_cache_top_up", "SELECT image_id FROM {emb} WHERE vec_id % 5 > 1")
def _(v):
    store = stores.EmbeddingStore(v.spark, scratch(v, "topup"))
    rows = v("emb")
    store.save(rows.where(F.col("vec_id") % 5 <= 1).select("image_id", "embedding", "category",
                                                           "split"), model_tag="m", kind="image")
    return store.missing(rows, model_tag="m", kind="image").select("image_id")


@query("s13_shard_tag", "SELECT DISTINCT category, substr(sha1(concat_ws('|', 'm', category, '0')), 1, 10) AS tag FROM {evt}")
def _(v):
    return v("evt").select("category", stores.shard_tag("m", F.col("category"), 0)
                           .alias("tag")).distinct()


@query("s15_text_store", "SELECT category, polarity, template_idx, len(embedding) AS dim FROM {txt}")
def _(v):
    path = scratch(v, "text")
    stores.write_table(v("txt"), path, ["category", "polarity"])
    return v.spark.read.parquet(path).select(
        "category", "polarity", "template_idx", F.size("embedding").cast("bigint").alias("dim"))


@query("s16_map_store", """SELECT category, count(DISTINCT image_id) AS n_maps, round(sum(vb), 6) AS total
FROM {pix} GROUP BY category""")
def _(v):
    path = scratch(v, "maps")
    stores.write_table(v("maps"), path, ["category", "map_kind"])
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return v.spark.read.parquet(path).where(F.col("map_kind") == "bank").groupBy("category").agg(
        F.count(F.lit(1)).alias("n_maps"), F.round(F.sum(total), 6).alias("total"))


@query("s18_synthetic_pool", """
SELECT image_id, CAST((rn - 1) % 2 AS INT) AS synthetic_anomaly, 'synthetic' AS split FROM (
  SELECT image_id, row_number() OVER (PARTITION BY category ORDER BY image_id) AS rn FROM {evt}
  WHERE split = 'train') q WHERE rn <= 200""")
def _(v):
    pool = index.synthetic_pool(v("evt").where(F.col("split") == "train"), 100)
    return pool.select("image_id", "synthetic_anomaly", "split")


@query("j10_flag_merge", """
SELECT e.image_id, e.anomaly_score, CAST((rn - 1) % 2 AS INT) AS synthetic_anomaly FROM (
  SELECT image_id, row_number() OVER (PARTITION BY category ORDER BY image_id) AS rn FROM {evt}
  WHERE split = 'train') q JOIN {evt} e ON e.image_id = q.image_id WHERE rn <= 200""")
def _(v):
    pool = index.synthetic_pool(v("evt").where(F.col("split") == "train"), 100)
    return index.merge_flag(v("evt"), pool).select("image_id", "anomaly_score",
                                                   "synthetic_anomaly")


@query("p9_class_name", "SELECT n_name, replace(n_name, '_', ' ') AS class_name FROM {nation}")
def _(v):
    return v("nation").select("n_name", class_name(F.col("n_name")).alias("class_name"))


@query("p11_confidence_map", """SELECT doc_id, CASE level WHEN 'HIGH' THEN 1.0::DOUBLE WHEN 'MEDIUM' THEN 0.5::DOUBLE WHEN 'LOW' THEN 0.0::DOUBLE END AS value
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'UNSURE' END AS level FROM {documents}) q""")
def _(v):
    levels = F.element_at(F.array(*[F.lit(x) for x in [*CONFIDENCE, "UNSURE"]]),
                          (F.col("doc_id") % 4 + 1).cast("int"))
    return v("documents").select("doc_id", signals.confidence_value(levels).alias("value"))


@query("p13_raw_logit", """SELECT image_id, round(ln(greatest(anomaly_score, 1e-9::DOUBLE) / greatest(1.0::DOUBLE - anomaly_score, 1e-9::DOUBLE)), 9) AS raw_score
FROM {evt} WHERE anomaly_score IS NOT NULL""")
def _(v):
    rows = v("evt").where(F.col("anomaly_score").isNotNull())
    return rows.select("image_id", F.round(raw_logit(F.col("anomaly_score")), 9)
                       .alias("raw_score"))


_TYPE = """CASE WHEN label = 1 AND conformal_pred = 1 THEN 'TP' WHEN label = 0 AND conformal_pred = 0 THEN 'TN'
  WHEN label = 1 THEN 'FN' ELSE 'FP' END"""


@query("p14_prediction_type", f"SELECT image_id, {_TYPE} AS prediction_type FROM {{scored}}", P)
def _(v):
    return browse.prediction_type(scored(v)).select("image_id", "prediction_type")


@query("p15_case_browser", f"""
SELECT image_id, category, label, anomaly_score, conformal_pred, {_TYPE} AS prediction_type, round(u_conformal, 9) AS u_conformal
FROM {{scored}} WHERE category = 'click' AND anomaly_score > 0.3 AND conformal_pred = 0
ORDER BY anomaly_score DESC, image_id LIMIT 10""", P)
def _(v):
    rows = browse.prediction_type(scored(v))
    out = browse.select_cases(rows, category="click",
                              filter_query="anomaly_score > 0.3 AND conformal_pred = 0",
                              sort_by="anomaly_score", ascending=False, n=10)
    return out.withColumn("u_conformal", F.round("u_conformal", 9))


@query("p16_median_decision", """
SELECT image_id, CASE WHEN anomaly_score > median(anomaly_score) OVER (PARTITION BY category) THEN 1 ELSE 0 END AS prediction FROM {evt}""")
def _(v):
    return browse.median_decision(v("evt")).select("image_id", "prediction")


_EXACT = """CASE WHEN label = 1 AND s = 1 THEN 'TP' WHEN label = 0 AND s = 0 THEN 'TN' WHEN label = 1 AND s = 0 THEN 'FN'
  WHEN label = 0 AND s = 1 THEN 'FP' ELSE 'Unknown' END"""
_UNANIMOUS = "least(1.0::DOUBLE, floor(anomaly_score * 2.5::DOUBLE) / 2.0::DOUBLE)"
_LEGACY = {"unan": f"SELECT *, {_EXACT} AS prediction_type FROM (SELECT *, {_UNANIMOUS} AS s, concat('d', event_no % 3) AS defect_type FROM {{evt}}) q"}


def unanimous(v):
    s = F.col("anomaly_score")
    rows = v("evt").withColumns({
        "anomaly_score": F.when(s.isNotNull(), F.least(F.lit(1.0), F.floor(s * 2.5) / 2.0)),
        "defect_type": F.concat(F.lit("d"), (F.col("event_no") % 3).cast("string"))})
    return browse.exact_outcome(rows)


# DuckDB's least() skips NULL, Spark's too: a missing score must stay missing.
_LEGACY["unan"] = _LEGACY["unan"].replace(
    f"{_UNANIMOUS} AS s", f"CASE WHEN anomaly_score IS NOT NULL THEN {_UNANIMOUS} END AS s")


@query("p17_exact_outcome", "SELECT image_id, prediction_type FROM {unan}", _LEGACY)
def _(v):
    return unanimous(v).select("image_id", "prediction_type")


@query("m16_outcome_pivot", """
SELECT category, tp AS "TP", tn AS "TN", fp AS "FP", fn AS "FN", u AS "Unknown", tp + tn AS "Correct", fp + fn AS "Wrong",
  round_even(100.0::DOUBLE * (tp + tn) / (tp + tn + fp + fn), 2) AS "Accuracy (%)" FROM (
  SELECT category, count(CASE WHEN prediction_type = 'TP' THEN 1 END) AS tp, count(CASE WHEN prediction_type = 'TN' THEN 1 END) AS tn,
    count(CASE WHEN prediction_type = 'FP' THEN 1 END) AS fp, count(CASE WHEN prediction_type = 'FN' THEN 1 END) AS fn,
    count(CASE WHEN prediction_type = 'Unknown' THEN 1 END) AS u FROM {unan} GROUP BY category) q""", _LEGACY)
def _(v):
    return browse.outcome_pivot(unanimous(v))


@query("m17_error_pivot", """
SELECT category, defect_type, count(CASE WHEN prediction_type = 'FP' THEN 1 END) AS "FP",
  count(CASE WHEN prediction_type = 'FN' THEN 1 END) AS "FN"
FROM {unan} WHERE prediction_type IN ('FP', 'FN') GROUP BY category, defect_type""", _LEGACY)
def _(v):
    return browse.error_pivot(unanimous(v))


@query("m18_outcome_counts", "SELECT prediction_type, count(*) AS count FROM {unan} GROUP BY prediction_type", _LEGACY)
def _(v):
    return browse.outcome_counts(unanimous(v))


@query("p18_canonical_defect", """
SELECT p_name, CASE word WHEN 'broken' THEN 'broken part' WHEN 'break' THEN 'broken part' WHEN 'cracked' THEN 'crack'
  WHEN 'scratched' THEN 'scratch' WHEN '' THEN 'none' WHEN 'n/a' THEN 'none' WHEN 'discolouration' THEN 'discoloration' ELSE word END AS defect
FROM (SELECT p_name, CASE p_partkey % 8 WHEN 0 THEN 'broken' WHEN 1 THEN 'break' WHEN 2 THEN 'cracked' WHEN 3 THEN 'scratched' WHEN 4 THEN ''
  WHEN 5 THEN 'n/a' WHEN 6 THEN 'discolouration' ELSE lower(p_name) END AS word FROM {part}) q""")
def _(v):
    words = ["broken", "Break ", "cracked", " SCRATCHED", "", "N/A", "discolouration"]
    word = F.lit(None).cast("string")
    for i, w in enumerate(words):
        word = F.when(F.col("p_partkey") % 8 == i, F.lit(w)).otherwise(word)
    word = F.when(F.col("p_partkey") % 8 == 7, F.col("p_name")).otherwise(word)
    return v("part").select("p_name", canonical_defect(word).alias("defect"))


_MEDIAN = {"med": """SELECT *, CASE WHEN anomaly_score > median(anomaly_score) OVER (PARTITION BY category) THEN 1 ELSE 0 END AS pred,
   (event_no * 31) % 101 / 101.0::DOUBLE AS uncertainty FROM {evt}""",
           "mauc": sql_auroc("{evt}", "category", "anomaly_score", "label")}


@query("m15_group_summary_median", """
SELECT m.category, count(*) AS n_images, round(max(a.auroc), 4) AS "AUROC",
  round(avg(CASE WHEN pred = label THEN uncertainty END), 4) AS uncertainty_correct,
  round(avg(CASE WHEN pred <> label THEN uncertainty END), 4) AS uncertainty_wrong
FROM {med} m JOIN {mauc} a ON a.category = m.category GROUP BY m.category""", _MEDIAN)
def _(v):
    rows = v("evt").withColumn("uncertainty", (F.col("event_no") * 31) % 101 / F.lit(101.0))
    return browse.group_summary(rows, ["uncertainty"])


@query("m15_group_summary_votes", """
SELECT m.category, count(*) AS n_images, round(max(a.auroc), 4) AS "AUROC",
  round(avg(CASE WHEN p5 = label THEN uncertainty END), 4) AS uncertainty_correct,
  round(avg(CASE WHEN p5 <> label THEN uncertainty END), 4) AS uncertainty_wrong
FROM (SELECT *, CASE WHEN anomaly_score > 0.5 THEN 1 ELSE 0 END AS p5 FROM {med}) m JOIN {mauc} a ON a.category = m.category
GROUP BY m.category""", _MEDIAN)
def _(v):
    rows = v("evt").withColumn("uncertainty", (F.col("event_no") * 31) % 101 / F.lit(101.0))
    return browse.group_summary(rows, ["uncertainty"], drop_single_class=True,
                                prediction=F.coalesce(F.col("anomaly_score") > 0.5, F.lit(False)))


@query("m15_overall_auroc", "SELECT round(avg(auroc), 4) AS overall_mean_auroc FROM {mauc}", _MEDIAN)
def _(v):
    summary = browse.group_summary(v("evt"), [], digits=None)
    return browse.overall_auroc(summary).select(
        F.round("overall_mean_auroc", 4).alias("overall_mean_auroc"))


_DECLARED = {f"u_{n}": (k, *signals.NOTES[n], b) for n, (k, b) in signals.KINDS.items()}
_DECLARED["u_conformal"] = signals.DERIVED


@query("u0_declarations", " UNION ALL ".join(
    "SELECT '{n}' AS signal, {0} AS kind, {1} AS inputs, {2} AS failure_modes, {b} AS is_baseline, count({c}) AS n_values FROM {{signals}}".format(
        *["'" + x.replace("'", "''") + "'" for x in _DECLARED[n][:3]], n=n, b=str(_DECLARED[n][3]).lower(), c=c)
    for n, c in (("u_abstention", "u_abstention"), ("u_conformal", "u_conformal"), ("u_verdict_var", "u_verdict_var"), ("u_token_entropy", "*"))), P)
def _(v):
    rows = signals.attach_signals(scored(v), ["abstention", "verdict_var", "token_entropy"])
    present = signals.signal_columns(rows)
    counts = records.signals_long(rows, ["image_id"]).groupBy("signal").agg(
        F.count("value").alias("n_values"))
    return signals.declarations(v.spark, present).join(counts, "signal")


@query("j12_records_vs_maps", """
SELECT c.image_id, CASE WHEN c.label = 0 THEN 'unverifiable' ELSE 'mask' END AS status,
  CASE WHEN c.vec_id % 4 = 0 THEN 'missing_map' ELSE 'map' END AS map_status FROM {claims} c""")
def _(v):
    maps = v("maps").where((F.col("map_kind") == "bank") & (F.col("vec_id") % 4 != 0))
    return grounding.with_evidence(v("claims"), maps, v("masks")).select("image_id", F.col("mask_status").alias("status"), "map_status")
