"""Embeddings, text scoring, neighbours, generations and the signals made from them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.calibration import scored
from catalog.evaluation import r9
from catalog.parts import P, sql_clip
from catalog.registry import query
from surety.functions.columns import anomaly_probability, l2_normalise, norm
from surety.operators import generations as gens
from surety.operators import scoring, semantic, signals
from surety.operators.neighbours import knn_distance
from surety.session import checkpoint_dir, materialise
from surety.sources import stores

TAU = 0.1
_SIG = f"1.0::DOUBLE / (1.0::DOUBLE + exp(-({{m}}) / {TAU}::DOUBLE))"

V = {
    "embd": "SELECT image_id, category, label, split, vec_id, embedding::DOUBLE[] AS e FROM {emb}",
    # Mean template vector per category and polarity, rescaled.
    "tmean": """SELECT category, polarity, list(m / greatest(nrm, 1e-8::DOUBLE) ORDER BY i) AS e FROM (
      SELECT *, sqrt(sum(m * m) OVER (PARTITION BY category, polarity)) AS nrm FROM (
        SELECT category, polarity, i, avg(x) AS m FROM (SELECT category, polarity, unnest(embedding) AS x,
          generate_subscripts(embedding, 1) AS i FROM {txt}) a GROUP BY 1, 2, 3) b) c GROUP BY 1, 2""",
    "scoreme": f"""SELECT e.image_id, e.category, e.label, e.split, list_dot_product(e.e, a.e) - list_dot_product(e.e, n.e) AS raw_score,
      {_SIG.format(m='list_dot_product(e.e, a.e) - list_dot_product(e.e, n.e)')} AS anomaly_score
      FROM {{embd}} e JOIN {{tmean}} n ON n.category = e.category AND n.polarity = 'normal'
      JOIN {{tmean}} a ON a.category = e.category AND a.polarity = 'anomaly'""",
    "tplrows": f"""SELECT e.image_id, e.category, e.label, e.split, n.template_idx AS i,
      list_dot_product(e.e, a.embedding) - list_dot_product(e.e, n.embedding) AS m
      FROM {{embd}} e JOIN {{txt}} n ON n.category = e.category AND n.polarity = 'normal'
      JOIN {{txt}} a ON a.category = e.category AND a.polarity = 'anomaly' AND a.template_idx = n.template_idx""",
}


def rounded_array(name):
    return F.transform(name, lambda x: F.round(x, 9)).alias(name)


@query("p1_l2_normalise", """
SELECT image_id, list_transform(e, lambda x: round(x / greatest(sqrt(list_dot_product(e, e)), 1e-8::DOUBLE), 9) + 0.0::DOUBLE) AS unit,
  round(sqrt(list_dot_product(e, e)), 9) AS norm
FROM (SELECT image_id, list_transform(e, lambda x: x * (vec_id % 7)) AS e FROM {embd}) q""", V)
def _(v):
    rows = v("emb").withColumn("v", F.transform(
        "embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7)))
    return rows.select("image_id", F.transform(l2_normalise(F.col("v")),
                                               lambda x: F.round(x, 9)).alias("unit"),
                       F.round(norm(F.col("v")), 9).alias("norm"))


@query("p2_softmax_probability", """SELECT image_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(anomaly_score - 0.4::DOUBLE) / 0.05::DOUBLE)), 9) AS p
FROM {evt} WHERE anomaly_score IS NOT NULL""")
def _(v):
    rows = v("evt").where(F.col("anomaly_score").isNotNull())
    return rows.select("image_id", F.round(anomaly_probability(
        F.lit(0.4), F.col("anomaly_score"), 0.05), 9).alias("p"))


@query("p3_score_mean_embedding", """SELECT image_id, round(anomaly_score, 9) AS anomaly_score, round(raw_score, 9) AS raw_score FROM {scoreme}""", V)
def _(v):
    out = scoring.score_mean_embedding(v("emb"), v("txt"), TAU)
    return r9(out.select("image_id", "anomaly_score", "raw_score"), "anomaly_score", "raw_score")


@query("p4_score_mean_template", f"""SELECT image_id, round(avg({_SIG.format(m='m')}), 9) AS anomaly_score, round(avg(m), 9) AS raw_score
FROM {{tplrows}} GROUP BY image_id""", V)
def _(v):
    out = scoring.score_index(v("emb").drop("embedding"), v("emb"), v("txt"), TAU,
                              "mean_template", keep_per_template=False)
    return r9(out.select("image_id", "anomaly_score", "raw_score"), "anomaly_score", "raw_score")


@query("p5_template_scores", f"""SELECT image_id, list(round({_SIG.format(m='m')}, 9) ORDER BY i) AS tpl, list(round(m, 9) ORDER BY i) AS tplraw
FROM {{tplrows}} GROUP BY image_id""", V)
def _(v):
    out = scoring.template_scores(v("emb"), v("txt"), TAU)
    return out.select("image_id", rounded_array("tpl"), rounded_array("tplraw"))


@query("p6_template_selection", """SELECT image_id, count(*) AS n_templates, round(max(m), 9) AS top FROM {tplrows} GROUP BY image_id""", V)
def _(v):
    rows = scoring.template_scores(v("emb"), v("txt"), TAU)
    wide = rows.select("image_id", *[F.col("tplraw")[i].alias(f"tplraw_{i:02d}")
                                     for i in range(5)])
    t = signals.template_array(wide, raw=True)
    return wide.select("image_id", F.size(t).cast("bigint").alias("n_templates"),
                       F.round(F.array_max(t), 9).alias("top"))


@query("p7_score_index", """SELECT image_id, split, label, true AS parse_ok, round(anomaly_score, 9) AS anomaly_score FROM {scoreme}""", V)
def _(v):
    out = scoring.score_index(v("emb").drop("embedding"), v("emb"), v("txt"), TAU)
    return r9(out.select("image_id", "split", "label", "parse_ok", "anomaly_score"),
              "anomaly_score")


@query("p8_score_view", f"""SELECT e.image_id, round({_SIG.format(m='-(list_dot_product(e.e, a.e) - list_dot_product(e.e, n.e))')}, 9) AS anomaly_score
FROM {{embd}} e JOIN {{tmean}} n ON n.category = e.category AND n.polarity = 'normal'
JOIN {{tmean}} a ON a.category = e.category AND a.polarity = 'anomaly'""", V)
def _(v):
    """Scores of a stored view whose vectors are the mirrored originals."""
    rows = v("emb")
    store = stores.EmbeddingStore(v.spark, f"{checkpoint_dir(v.spark)}/surety-{uuid.uuid4().hex}")
    store.save(rows, model_tag="m", kind="image")
    store.save(rows.withColumn("embedding", F.transform("embedding", lambda x: -x)),
               model_tag="m", kind="image", extra="mirrored")
    view = store.load(model_tag="m", kind="image", extra="mirrored")
    out = scoring.score_index(rows.drop("embedding"), view, v("txt"), TAU,
                              keep_per_template=False)
    return r9(out.select("image_id", "anomaly_score"), "anomaly_score")


@query("j1_records_vs_embeddings", """SELECT r.image_id, e.image_id IS NOT NULL AS found, len(e.embedding) AS dim
FROM (SELECT concat('v', CAST(event_id AS STRING)) AS image_id FROM {events}) r LEFT JOIN {emb} e ON e.image_id = r.image_id""")
def _(v):
    ids = v("events").select(F.concat(F.lit("v"), F.col("event_id").cast("string"))
                             .alias("image_id"))
    emb = v("emb").select("image_id", "embedding")
    found = ids.join(emb, "image_id").select(
        "image_id", F.lit(True).alias("found"), F.size("embedding").cast("bigint").alias("dim"))
    lost = stores.missing_rows(ids, emb).select(
        "image_id", F.lit(False).alias("found"), F.lit(None).cast("bigint").alias("dim"))
    return found.unionByName(lost)


K = {
    **V,
    "sims": """SELECT q.image_id, q.category, q.label, q.split, list_dot_product(q.e, b.e)
        / (greatest(sqrt(list_dot_product(q.e, q.e)), 1e-8::DOUBLE) * greatest(sqrt(list_dot_product(b.e, b.e)), 1e-8::DOUBLE)) AS sim
      FROM {embd} q JOIN {embd} b ON b.category = q.category WHERE b.split = 'train'""",
    "knn": """SELECT image_id, any_value(category) AS category, 1.0::DOUBLE - avg(sim) AS distance FROM (
      SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY sim DESC) AS rn FROM {sims}) q WHERE rn <= 5 GROUP BY image_id""",
}


def bank(v):
    return v("emb").where(F.col("split") == "train")


@query("k1_knn_distance", "SELECT image_id, category, round(distance, 9) AS distance FROM {knn}", K)
def _(v):
    out = knn_distance(v("emb"), bank(v), ["category"], 5, ["image_id"], "image_id")
    return r9(out, "distance")


@query("k1_knn_distance_blocks", "SELECT image_id, category, round(distance, 9) AS distance FROM {knn}", K)
def _(v):
    """The same distances with blocks small enough to cut every group."""
    out = knn_distance(v("emb"), bank(v), ["category"], 5, ["image_id"], "image_id", block=16)
    return r9(out, "distance")


@query("j6_query_vs_bank", """SELECT image_id, count(*) AS n_bank, round(max(sim), 9) AS nearest FROM {sims} GROUP BY image_id""", K)
def _(v):
    near = knn_distance(v("emb"), bank(v), ["category"], 1, ["image_id"], "image_id")
    sizes = bank(v).groupBy("category").agg(F.count(F.lit(1)).alias("n_bank"))
    return near.join(sizes, "category").select(
        "image_id", "n_bank", F.round(1.0 - F.col("distance"), 9).alias("nearest"))


@query("u1_prompt_std", "SELECT image_id, round(stddev_pop(m), 9) AS u_prompt_std FROM {tplrows} GROUP BY image_id", V)
def _(v):
    rows = scoring.template_scores(v("emb"), v("txt"), TAU)
    return r9(signals.prompt_std(rows, raw=True).select("image_id", "u_prompt_std"),
              "u_prompt_std")


_REF = {**V, "ref": """SELECT category, i, avg(m) AS mu, stddev_pop(m) AS sd FROM {tplrows} WHERE split = 'train' GROUP BY 1, 2""",
        "tref": "SELECT category, i, avg(m) AS mu, stddev_pop(m) AS sd FROM {tplrows} GROUP BY 1, 2"}
_Z = """SELECT t.image_id, round(stddev_pop((t.m - r.mu) / (CASE WHEN r.sd > 0 THEN r.sd ELSE 1 END)), 9) AS u_prompt_std_z
FROM {tplrows} t JOIN {@} r ON r.category = t.category AND r.i = t.i GROUP BY t.image_id"""


@query("u2_prompt_std_z", _Z.replace("@", "ref"), _REF)
def _(v):
    rows = scoring.template_scores(v("emb"), v("txt"), TAU)
    ref = signals.template_reference(rows.where(F.col("split") == "train"))
    return r9(signals.prompt_std_z(rows, ref).select("image_id", "u_prompt_std_z"),
              "u_prompt_std_z")


@query("u2_prompt_std_z_transductive", _Z.replace("@", "tref"), _REF)
def _(v):
    rows = scoring.template_scores(v("emb"), v("txt"), TAU)
    return r9(signals.prompt_std_z(rows).select("image_id", "u_prompt_std_z"), "u_prompt_std_z")


def _rank(value: str, part: str) -> str:
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {value}) + (count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2.0::DOUBLE)"
            f" / count(*) OVER (PARTITION BY {part})")


@query("u3_backbone_ensemble", f"""
SELECT e.image_id, round(u, 9) AS u_backbone_ens FROM {{evt}} e LEFT JOIN (
  SELECT image_id, stddev_pop(r) AS u FROM (SELECT image_id, {_rank('anomaly_score', 'model_tag, category')} AS r
    FROM {{models}} WHERE anomaly_score IS NOT NULL) q GROUP BY image_id) z ON z.image_id = e.image_id""")
def _(v):
    out = signals.backbone_ensemble(v("evt"), v("models"), ["m0", "m1", "m2"])
    return r9(out.select("image_id", "u_backbone_ens"), "u_backbone_ens")


@query("u4_tta_variance", """SELECT e.image_id, round(u, 9) AS u_tta_var FROM {evt} e LEFT JOIN (
  SELECT image_id, max(anomaly_score) - min(anomaly_score) AS u FROM {models} GROUP BY image_id) z ON z.image_id = e.image_id""")
def _(v):
    views = v("models").withColumnRenamed("model_tag", "view")
    out = signals.tta_variance(v("evt"), views, ["m0", "m1", "m2"], stat="range")
    return r9(out.select("image_id", "u_tta_var"), "u_tta_var")


J3 = """SELECT e.image_id, count(m.anomaly_score) AS n_scores, round(sum(m.anomaly_score), 9) AS total
FROM {evt} e LEFT JOIN {models} m ON m.image_id = e.image_id GROUP BY e.image_id"""


def per_record(long):
    """Number and sum of the scores of each record, added up in the order of the models."""
    scores = F.array_sort(F.collect_list(F.when(F.col("model_score").isNotNull(), F.struct("model_tag", "model_score"))))
    total = F.when(F.count("model_score") > 0, F.aggregate(scores, F.lit(0.0), lambda s, x: s + x["model_score"]))
    return long.groupBy("image_id").agg(F.count("model_score").alias("n_scores"), F.round(total, 9).alias("total"))


@query("j3_records_vs_models", J3)
def _(v):
    return per_record(signals.model_scores(v("evt"), v("models"), []))


@query("j3_copartitioned_scores", J3)
def _(v):
    """The same join of two stored tables that share their buckets."""
    store = stores.CoPartitioned(v.spark, f"{checkpoint_dir(v.spark)}/surety-{uuid.uuid4().hex}", buckets=8)
    store.save("records", v("evt"))
    store.save("scores", v("models"))
    return per_record(signals.model_scores(store.load("records"), store.load("scores"), []))


@query("u5_manifold_knn", f"""SELECT image_id, round({_rank('round(distance, 9)', 'category')}, 9) AS u_manifold_knn FROM {{knn}}""", K)
def _(v):
    rows = v("emb")
    # Similarities are rounded inside, so equal distances tie in both engines.
    out = signals.manifold_distance(rows.drop("embedding"), rows, bank(v), ranked=True)
    return r9(out.select("image_id", "u_manifold_knn"), "u_manifold_knn")


@query("u6_manifold_knn_raw", "SELECT image_id, round(distance, 9) AS u_manifold_knn_raw FROM {knn}", K)
def _(v):
    rows = v("emb")
    out = signals.manifold_distance(rows.drop("embedding"), rows, bank(v), ranked=False)
    return r9(out.select("image_id", "u_manifold_knn_raw"), "u_manifold_knn_raw")


@query("u7_set_size", """SELECT image_id, set_size, CASE set_size WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS u_set_size
FROM (SELECT image_id, CAST(event_no % 3 AS INT) AS set_size FROM {evt}) q""")
def _(v):
    rows = v("evt").withColumn("set_size", (F.col("event_no") % 3).cast("int"))
    return signals.set_size(rows).select("image_id", "set_size", "u_set_size")


_H = f"-({sql_clip('s')} * log2({sql_clip('s')}) + (1.0::DOUBLE - {sql_clip('s')}) * log2(1.0::DOUBLE - {sql_clip('s')}))"


@query("u8_token_entropy", f"""SELECT image_id, CASE WHEN parse_ok THEN round({_H}, 9) ELSE 1.0::DOUBLE END AS u_token_entropy
FROM (SELECT *, anomaly_score AS s FROM {{evt}}) q""")
def _(v):
    return r9(signals.token_entropy(v("evt")).select("image_id", "u_token_entropy"),
              "u_token_entropy")


@query("u10_prompt_perturbation", """SELECT e.image_id, coalesce(round(u, 9), 1.0::DOUBLE) AS u_prompt_perturb FROM {evt} e LEFT JOIN (
  SELECT image_id, stddev_pop(anomaly_score) AS u FROM {models} GROUP BY image_id) z ON z.image_id = e.image_id""")
def _(v):
    variants = v("models").where(F.col("model_tag") != "m0").groupBy("image_id").agg(
        F.map_from_entries(F.collect_list(F.struct("model_tag", "anomaly_score")))
        .alias("variant_pyes"))
    out = signals.prompt_perturbation(v("evt").join(variants, "image_id", "left"))
    return r9(out.select("image_id", "u_prompt_perturb"), "u_prompt_perturb")


@query("u12_verdict_variance", """SELECT image_id, round(sqrt(anomaly_score * (1.0::DOUBLE - anomaly_score)), 9) AS u_verdict_var FROM {evt}""")
def _(v):
    return r9(signals.verdict_variance(v("evt")).select("image_id", "u_verdict_var"),
              "u_verdict_var")


@query("u13_abstention", "SELECT image_id, CASE WHEN parse_ok THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS u_abstention FROM {evt}")
def _(v):
    return signals.abstention(v("evt")).select("image_id", "u_abstention")


@query("u14_conformal_uncertainty", "SELECT image_id, round(u_conformal, 9) AS u_conformal FROM {scored}", P)
def _(v):
    return r9(scored(v).select("image_id", "u_conformal"), "u_conformal")


@query("u15_pct_rank", f"""SELECT e.image_id, round(r, 9) AS in_group, round(g, 9) AS overall FROM {{evt}} e LEFT JOIN (
  SELECT image_id, {_rank('anomaly_score', 'category')} AS r, {_rank('anomaly_score', '1')} AS g
  FROM {{vote}} WHERE anomaly_score IS NOT NULL) q ON q.image_id = e.image_id""")
def _(v):
    rows = signals.pct_rank(v("vote"), "anomaly_score", ["category"], "in_group")
    rows = signals.pct_rank(rows, "anomaly_score", [], "overall")
    return r9(rows.select("image_id", "in_group", "overall"), "in_group", "overall")


@query("u16_zscore", """SELECT image_id,
  round((anomaly_score - avg(anomaly_score) OVER (PARTITION BY category)) / stddev_pop(anomaly_score) OVER (PARTITION BY category), 9) AS in_group,
  round((anomaly_score - avg(anomaly_score) OVER ()) / stddev_pop(anomaly_score) OVER (), 9) AS overall FROM {evt}""")
def _(v):
    rows = signals.zscore(v("evt"), "anomaly_score", ["category"], "in_group")
    rows = signals.zscore(rows, "anomaly_score", [], "overall")
    return r9(rows.select("image_id", "in_group", "overall"), "in_group", "overall")


@query("u17_attach_signals", f"""
SELECT e.image_id, round(z.u, 9) AS u_backbone_ens, CASE WHEN parse_ok THEN round({_H}, 9) ELSE 1.0::DOUBLE END AS u_token_entropy,
  CASE WHEN parse_ok THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS u_abstention
FROM (SELECT *, anomaly_score AS s FROM {{evt}}) e LEFT JOIN (
  SELECT image_id, stddev_pop(r) AS u FROM (SELECT image_id, {_rank('anomaly_score', 'model_tag, category')} AS r
    FROM {{models}} WHERE anomaly_score IS NOT NULL AND model_tag <> 'm1') q GROUP BY image_id) z ON z.image_id = e.image_id""")
def _(v):
    """The augmentation signal has no views here and is skipped."""
    out = signals.attach_signals(
        v("evt"), ["token_entropy", "backbone_ens", "tta_var", "abstention"],
        {"backbone_ens": {"scores": v("models"), "models": ["m0", "m2"]}})
    return r9(out.select("image_id", "u_backbone_ens", "u_token_entropy", "u_abstention"),
              "u_backbone_ens", "u_token_entropy")


def _field(name: str, stops: str) -> str:
    raw = f"regexp_extract(text, '(?is){name}:\\s*(.+?)(?:{stops}|\\z)', 1)"
    bare = f"regexp_replace(regexp_replace({raw}, '^\\s+|\\s+$', '', 'g'), '^\\*+|\\*+$', '', 'g')"
    return f"regexp_replace(regexp_replace({bare}, '\\s+', ' ', 'g'), '^ | $', '', 'g')"


G = {"gp": f"""
SELECT image_id, sample_idx, text,
  CASE WHEN ans <> '' THEN CASE WHEN ans = 'YES' THEN 1 ELSE 0 END WHEN last = 'YES' THEN 1 WHEN last = 'NO' THEN 0 END AS vote,
  observation, defect_type, location, confidence
FROM (SELECT image_id, sample_idx, text, upper(regexp_extract(text, '(?i)ANSWER:\\s*\\**\\s*(YES|NO)', 1)) AS ans,
  upper(regexp_replace(regexp_extract(text, '([^\\r\\n]*\\S[^\\r\\n]*)\\s*\\z', 1), '^[\\s*.]+|[\\s*.]+$', '', 'g')) AS last,
  {_field('OBSERVATION', 'DEFECT_TYPE:|ANSWER:')} AS observation, {_field('DEFECT_TYPE', 'DEFECT_LOCATION:|ANSWER:')} AS defect_type,
  {_field('DEFECT_LOCATION', 'CONFIDENCE:|ANSWER:')} AS location,
  upper(regexp_extract(text, '(?i)CONFIDENCE:\\s*\\**\\s*(HIGH|MEDIUM|LOW)', 1)) AS confidence FROM {{gen}}) q"""}
_FIELDS = "image_id, sample_idx, vote, observation, defect_type, location, confidence"


@query("p10_parse_generation", f"SELECT {_FIELDS} FROM {{gp}}", G)
def _(v):
    return gens.parse(v("gen")).select(*_FIELDS.split(", "))


@query("s14_generations_store", f"SELECT {_FIELDS} FROM {{gp}}", G)
def _(v):
    path = f"{checkpoint_dir(v.spark)}/surety-generations-{uuid.uuid4().hex}"
    stores.write_generations(gens.parse(v("gen")), path)
    out = stores.explode_generations(stores.read_generations(v.spark, path))
    # Samples are numbered by position; here that equals the turn.
    return out.select(*_FIELDS.split(", ")).na.fill(
        "", ["observation", "defect_type", "location", "confidence"])


@query("m13_vote_aggregate", """
SELECT image_id, avg(vote) AS vote_fraction, count(vote) AS n_valid_votes, count(vote) > 0 AS parse_ok, count(*) AS n_generations,
  min_by(observation, sample_idx) AS observation, min_by(defect_type, sample_idx) AS predicted_defect,
  min_by(location, sample_idx) AS predicted_location, min_by(confidence, sample_idx) AS predicted_confidence
FROM {gp} GROUP BY image_id""", G)
def _(v):
    return gens.vote_aggregate(gens.parse(v("gen")))


_LSE = "(list_max({x}) + ln(list_sum(list_transform({x}, lambda y: exp(y - list_max({x}))))))"
TOK = {"verdicts": f"""
SELECT gen_id, coalesce(min_by(pos, pos) FILTER (cand AND pos > mark), max(pos) FILTER (cand)) AS verdict_pos,
  coalesce(min_by(p, pos) FILTER (cand AND pos > mark), max_by(p, pos) FILTER (cand)) AS p_yes
FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp({_LSE.format(x='no_logprobs')} - {_LSE.format(x='yes_logprobs')})) AS p,
    lower(trim(token)) IN ('yes', 'no') AS cand,
    min(CASE WHEN contains(token, 'ANSWER') THEN pos END) OVER (PARTITION BY gen_id) AS mark FROM {{tok}}) q GROUP BY gen_id"""}


@query("p12_verdict_probability", """SELECT gen_id, CAST(verdict_pos AS INT) AS verdict_pos, round(p_yes, 9) AS p_yes FROM {verdicts}""", TOK)
def _(v):
    return r9(gens.verdict_probability(v("tok")), "p_yes")


@query("p12_generation_records", """
SELECT g.image_id, round(q.p_yes, 9) AS anomaly_score, q.p_yes IS NOT NULL AS parse_ok, g.n AS n_generations
FROM (SELECT image_id, count(*) AS n FROM {gen} GROUP BY image_id) g
LEFT JOIN (SELECT split_part(gen_id, '-', 1) AS image_id, p_yes FROM {verdicts} WHERE split_part(gen_id, '-', 2) = '0') q
  ON q.image_id = g.image_id""", TOK)
def _(v):
    votes = gens.vote_aggregate(gens.parse(v("gen")))
    tokens = v("tok").where(F.split("gen_id", "-")[1] == "0").withColumn(
        "image_id", F.split("gen_id", "-")[0])
    p = gens.verdict_probability(tokens, gen="image_id")
    out = gens.generation_records(votes, p)
    return r9(out.select("image_id", "anomaly_score", "parse_ok", "n_generations"),
              "anomaly_score")


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_THRESHOLD = 0.97
#: Samples with the unit vector of their letter counts, their greedy clusters, and those by entailment.
_CL = {**G,
  "said": """SELECT image_id, sample_idx, vote, lower(trim(CASE WHEN length(observation) > 0 THEN observation ELSE text END)) AS t,
    row_number() OVER (PARTITION BY image_id ORDER BY sample_idx) AS rn FROM {gp} WHERE vote IS NOT NULL""",
  "lv": f"""SELECT image_id, sample_idx, vote, rn, list_transform(c, lambda x: x / greatest(sqrt(list_dot_product(c, c)), 1e-8::DOUBLE)) AS v
    FROM (SELECT *, [{', '.join(f"(length(t) - length(replace(t, '{x}', '')))::DOUBLE" for x in _LETTERS)}] AS c FROM {{said}}) q""",
  "gc": f"""SELECT image_id, rn, [v] AS leaders, 0 AS cluster FROM {{lv}} WHERE rn = 1
    UNION ALL SELECT image_id, rn, CASE WHEN hit > 0 THEN leaders ELSE list_append(leaders, v) END, CASE WHEN hit > 0 THEN hit - 1 ELSE len(leaders) END
    FROM (SELECT n.image_id, n.rn, n.v, g.leaders, coalesce(list_position(list_transform(g.leaders, lambda l: list_dot_product(l, n.v) >= {_THRESHOLD}), true), 0) AS hit
      FROM {{gc}} g JOIN {{lv}} n ON n.image_id = g.image_id AND n.rn = g.rn + 1) z""",
  "cl": "SELECT l.image_id, l.sample_idx, l.vote, CAST(g.cluster AS BIGINT) AS cluster FROM {lv} l JOIN {gc} g ON g.image_id = l.image_id AND g.rn = l.rn",
  "said_words": "SELECT image_id, rn, list_distinct(string_split_regex(t, '\\W+')) AS w FROM {said}",
  "mutual": """SELECT a.image_id, a.rn, list(least(len(list_intersect(a.w, b.w))::DOUBLE / len(a.w), len(list_intersect(a.w, b.w))::DOUBLE / len(b.w)) ORDER BY b.rn) AS m
    FROM {said_words} a JOIN {said_words} b ON b.image_id = a.image_id GROUP BY a.image_id, a.rn""",
  "ec": """SELECT image_id, rn, [rn] AS leaders, 0 AS cluster FROM {mutual} WHERE rn = 1
    UNION ALL SELECT image_id, rn, CASE WHEN list_max(s) >= 0.5 THEN leaders ELSE list_append(leaders, rn) END,
      CASE WHEN list_max(s) >= 0.5 THEN list_position(s, list_max(s)) - 1 ELSE len(leaders) END
    FROM (SELECT n.image_id, n.rn, g.leaders, list_transform(g.leaders, lambda l: n.m[l]) AS s
      FROM {ec} g JOIN {mutual} n ON n.image_id = g.image_id AND n.rn = g.rn + 1) z""",
  "ent": """SELECT image_id, CAST(sum(c) AS BIGINT) AS n, CASE WHEN sum(c) = 1 THEN 0.0::DOUBLE ELSE
    greatest((ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(sum(c)), 0) END AS entropy
    FROM (SELECT image_id, cluster, count(*) AS c FROM {cl} GROUP BY 1, 2) q GROUP BY image_id""",
  "jent": """SELECT image_id, CAST(sum(c) AS BIGINT) AS n, CASE WHEN sum(c) = 1 THEN 0.0::DOUBLE ELSE
    greatest((ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(sum(c)), 0) END AS entropy
    FROM (SELECT image_id, vote, cluster, count(*) AS c FROM {cl} GROUP BY 1, 2, 3) q GROUP BY image_id"""}


def samples(v):
    """Valid samples with the unit vector of the letter counts of what they say."""
    said = semantic.valid_samples(gens.parse(v("gen")))
    t = F.lower("said")
    counts = F.array(*[(F.length(t) - F.length(F.replace(t, F.lit(x), F.lit("")))).cast("double") for x in _LETTERS])
    return said.withColumn("vector", l2_normalise(counts))


def clustered(v):
    return semantic.greedy_clusters(samples(v), _THRESHOLD)


@query("g1_semantic_clusters", "SELECT image_id, sample_idx, vote, cluster FROM {cl}", _CL, recursive=True)
def _(v):
    return clustered(v)


@query("g1_hashed_text_clusters")
def _(v):
    return semantic.greedy_clusters(semantic.hashed_text_vector(semantic.valid_samples(gens.parse(v("gen")))))


@query("g1_entailment_clusters", """SELECT s.image_id, s.sample_idx, s.vote, CAST(e.cluster AS BIGINT) AS cluster
FROM {said} s JOIN {ec} e ON e.image_id = s.image_id AND e.rn = s.rn""", _CL, recursive=True)
def _(v):
    """Entailment scores from word overlap: the share of the premise's words that recur."""
    said = materialise(semantic.valid_samples(gens.parse(v("gen"))).withColumn(
        "words", F.array_distinct(F.split(F.lower("said"), r"\W+"))))
    left = said.select("image_id", F.col("sample_idx").alias("premise"),
                       F.col("words").alias("a"))
    right = said.select("image_id", F.col("sample_idx").alias("hypothesis"),
                        F.col("words").alias("b"))
    pairs = left.join(right, "image_id").select(
        "image_id", "premise", "hypothesis",
        (F.size(F.array_intersect("a", "b")) / F.size("a")).alias("entail"))
    return semantic.entailment_clusters(said, pairs)


@query("g2_cluster_entropy", "SELECT image_id, n, round(entropy, 9) AS entropy FROM {ent}", _CL, recursive=True)
def _(v):
    return r9(semantic.cluster_entropy(clustered(v)), "entropy")


@query("g3_joint_entropy", "SELECT image_id, n, round(entropy, 9) AS entropy FROM {jent}", _CL, recursive=True)
def _(v):
    return r9(semantic.joint_entropy(clustered(v)), "entropy")


_CANON = """CASE lower(defect_type) WHEN 'cracked' THEN 'crack' WHEN '' THEN 'none' ELSE lower(defect_type) END"""


@query("g4_signature_entropy", """
SELECT e.image_id, round(e.entropy, 9) AS semantic_entropy, round(1.0::DOUBLE - c.conf, 9) AS confidence_uncertainty
FROM {sent} e JOIN (SELECT image_id, avg(CASE confidence WHEN 'HIGH' THEN 1.0::DOUBLE WHEN 'MEDIUM' THEN 0.5::DOUBLE WHEN 'LOW' THEN 0.0::DOUBLE END) AS conf
  FROM {gp} WHERE vote IS NOT NULL GROUP BY image_id) c ON c.image_id = e.image_id""",
       {**G, "sent": f"""SELECT image_id, CASE WHEN sum(c) = 1 THEN 0.0::DOUBLE ELSE
         greatest((ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(sum(c)), 0) END AS entropy
         FROM (SELECT image_id, vote, {_CANON} AS d, count(*) AS c FROM {{gp}} WHERE vote IS NOT NULL GROUP BY 1, 2, 3) q GROUP BY image_id"""})
def _(v):
    return r9(semantic.signature_entropy(gens.parse(v("gen"))), "semantic_entropy",
              "confidence_uncertainty")


@query("u9_semantic_entropy", """SELECT i.image_id, round(coalesce(e.entropy, 1.0::DOUBLE), 9) AS u_semantic_entropy
FROM (SELECT DISTINCT image_id FROM {gp}) i LEFT JOIN {ent} e ON e.image_id = i.image_id""", _CL, recursive=True)
def _(v):
    rows = gens.vote_aggregate(gens.parse(v("gen")))
    out = signals.attach_signals(rows, ["semantic_entropy"], {"semantic_entropy": {"clusters": clustered(v)}})
    return r9(out.select("image_id", "u_semantic_entropy"), "u_semantic_entropy")


@query("u9_semantic_entropy_joint", """SELECT i.image_id, round(coalesce(e.entropy, 1.0::DOUBLE), 9) AS u_semantic_entropy
FROM (SELECT DISTINCT image_id FROM {gp}) i LEFT JOIN {jent} e ON e.image_id = i.image_id""", _CL, recursive=True)
def _(v):
    rows = gens.vote_aggregate(gens.parse(v("gen")))
    out = semantic.semantic_entropy(rows, clustered(v), joint=True)
    return r9(out.select("image_id", "u_semantic_entropy"), "u_semantic_entropy")


@query("u9_semantic_entropy_clustered")
def _(v):
    rows = gens.vote_aggregate(gens.parse(v("gen")))
    hashed = semantic.hashed_text_vector(semantic.valid_samples(gens.parse(v("gen"))))
    return semantic.semantic_entropy(rows, semantic.greedy_clusters(hashed), joint=True).select("image_id", "u_semantic_entropy")


@query("u11_verbalized_confidence", """
SELECT i.image_id, round(coalesce(1.0::DOUBLE - c.conf, 1.0::DOUBLE), 9) AS u_verbalized_conf
FROM (SELECT DISTINCT image_id FROM {gp}) i LEFT JOIN (
  SELECT image_id, avg(CASE confidence WHEN 'HIGH' THEN 1.0::DOUBLE WHEN 'MEDIUM' THEN 0.5::DOUBLE WHEN 'LOW' THEN 0.0::DOUBLE END) AS conf
  FROM {gp} GROUP BY image_id) c ON c.image_id = i.image_id""", G)
def _(v):
    parsed = gens.parse(v("gen"))
    out = signals.verbalized_confidence(gens.vote_aggregate(parsed), parsed)
    return r9(out.select("image_id", "u_verbalized_conf"), "u_verbalized_conf")


@query("u11_verbalized_confidence_head", """
SELECT image_id, coalesce(1.0::DOUBLE - CASE min_by(confidence, sample_idx) WHEN 'HIGH' THEN 1.0::DOUBLE WHEN 'MEDIUM' THEN 0.5::DOUBLE WHEN 'LOW' THEN 0.0::DOUBLE END,
  1.0::DOUBLE) AS u_verbalized_conf FROM {gp} GROUP BY image_id""", G)
def _(v):
    rows = gens.vote_aggregate(gens.parse(v("gen")))
    return signals.verbalized_confidence(rows).select("image_id", "u_verbalized_conf")


@query("s14_records_with_generations", """
SELECT g.image_id, count(q.sample_idx) AS n_samples FROM (SELECT concat('g', CAST(doc_id AS STRING)) AS image_id FROM {documents}) g
LEFT JOIN {gp} q ON q.image_id = g.image_id GROUP BY g.image_id""", G)
def _(v):
    ids = v("documents").select(F.concat(F.lit("g"), F.col("doc_id").cast("string"))
                                .alias("image_id"))
    packed = stores.pack_generations(gens.parse(v("gen")))
    out = stores.records_with_generations(ids, packed)
    n = F.size(F.from_json("generations", stores.SAMPLE_TYPE))
    return out.select("image_id", n.cast("bigint").alias("n_samples"))


