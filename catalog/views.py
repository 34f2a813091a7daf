"""Input views derived from the driver tables.

Each view is one SQL text that Spark and DuckDB both run; ``{name}`` stands for a table or for
an earlier view. ``spark_view`` builds the DataFrame, ``cte`` the same text for the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

VIEWS: dict[str, str] = {}
#: Views whose text differs between the engines: array building and unnesting.
DUCK_VIEWS: dict[str, str] = {}

VIEWS["evt"] = """
SELECT concat('e', CAST(event_id AS STRING)) AS image_id, event_type AS category, label,
  CASE WHEN label = 0 AND event_id % 2 = 0 THEN 'train' ELSE 'test' END AS split,
  (event_id % 37 <> 5) AS parse_ok,
  CASE WHEN event_id % 37 <> 5 THEN round(CAST(0.6 AS DOUBLE) * value / (value + CAST(20 AS DOUBLE))
    + CAST(0.25 AS DOUBLE) * label
    + CAST(0.15 AS DOUBLE) * CAST((event_id * 104729) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE), 6) END
    AS anomaly_score, event_id AS event_no
FROM (SELECT *, CASE WHEN (event_id * 7919 + user_id) % 10 < 3 THEN 1 ELSE 0 END AS label
      FROM {events}) e
"""

VIEWS["doc"] = """
SELECT concat('d', CAST(d.doc_id AS STRING)) AS image_id, d.lang AS category,
  CASE WHEN l.toxic = 1 OR l.quality = 0 THEN 1 ELSE 0 END AS label,
  CASE WHEN d.doc_id % 3 = 0 AND l.toxic = 0 AND l.quality = 1 THEN 'train' ELSE 'test' END AS split,
  true AS parse_ok,
  round(CAST(0.5 AS DOUBLE) * CAST(d.n_chars % 997 AS DOUBLE) / CAST(997 AS DOUBLE)
    + CASE WHEN l.quality = 0 OR l.toxic = 1 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
    + CAST(0.2 AS DOUBLE) * CAST((d.doc_id * 31) % 101 AS DOUBLE) / CAST(101 AS DOUBLE), 6)
    AS anomaly_score
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""

VIEWS["line"] = """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',
    CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-',
    CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS image_id,
  concat(l_returnflag, l_linestatus) AS category, label,
  CASE WHEN label = 0 AND l_partkey % 2 = 0 THEN 'train' ELSE 'test' END AS split,
  true AS parse_ok,
  round(CAST(0.55 AS DOUBLE) * l_extendedprice / (l_extendedprice + CAST(40000 AS DOUBLE))
    + CAST(0.3 AS DOUBLE) * label + CAST(0.15 AS DOUBLE) * l_quantity / CAST(50 AS DOUBLE), 6)
    AS anomaly_score
FROM (SELECT *, CASE WHEN (l_orderkey * 7 + l_partkey) % 10 < 2 THEN 1 ELSE 0 END AS label
      FROM {lineitem}) t
"""

# A second scorer for the same images; not rounded, so both engines hold the same double.
VIEWS["evt_b"] = """
SELECT image_id, category, label, split, parse_ok,
  CAST(0.5 AS DOUBLE) * anomaly_score
    + CAST(0.001 AS DOUBLE) * CAST((event_no * 17) % 97 AS DOUBLE) AS anomaly_score
FROM {evt}
"""

# Scores snapped to tenths: heavy ties.
VIEWS["vote"] = """
SELECT image_id, category, label, split, parse_ok,
  floor(anomaly_score * CAST(10 AS DOUBLE)) / CAST(10 AS DOUBLE) AS anomaly_score, event_no
FROM {evt}
"""

# The same images under three deterministic distortions, one row per (image, model).
VIEWS["models"] = """
SELECT image_id, category, label, split, 'm0' AS model_tag, anomaly_score FROM {evt}
UNION ALL
SELECT image_id, category, label, split, 'm1' AS model_tag,
  anomaly_score * anomaly_score AS anomaly_score FROM {evt}
UNION ALL
SELECT image_id, category, label, split, 'm2' AS model_tag,
  CAST(0.7 AS DOUBLE) * anomaly_score
    + CAST(0.01 AS DOUBLE) * CAST((event_no * 7) % 31 AS DOUBLE) AS anomaly_score FROM {evt}
"""

# Synthetic anomaly pool: paired training rows, every second one shifted up.
VIEWS["syn"] = """
SELECT image_id, category, split, parse_ok, synthetic_anomaly, synthetic_anomaly AS label, event_no,
  CASE WHEN synthetic_anomaly = 1
    THEN least(CAST(1 AS DOUBLE), anomaly_score + CAST(0.3 AS DOUBLE))
    ELSE anomaly_score END AS anomaly_score
FROM (SELECT image_id, category, 'synthetic' AS split, parse_ok, anomaly_score, event_no,
        CAST(CAST(floor(CAST(event_no AS DOUBLE) / CAST(2 AS DOUBLE)) AS BIGINT) % 2 AS INT) AS synthetic_anomaly
      FROM {evt} WHERE split = 'train') t
"""
# Distribution-shift cells: one clean cell and three named shifts at five severities.
VIEWS["sweep"] = """
SELECT t.image_id, t.category, t.label, t.split, t.parse_ok, g.corruption,
  CAST(g.severity AS BIGINT) AS severity,
  CASE g.corruption
    WHEN 'pull' THEN t.anomaly_score
      + (CAST(0.5 AS DOUBLE) - t.anomaly_score) * (g.severity * CAST(0.08 AS DOUBLE))
    WHEN 'shift' THEN t.anomaly_score + g.severity * CAST(0.03 AS DOUBLE)
      + CAST((t.event_no * 13) % 11 AS DOUBLE) * (g.severity * CAST(0.01 AS DOUBLE))
    ELSE t.anomaly_score END AS anomaly_score
FROM {evt} t CROSS JOIN (
  SELECT 'none' AS corruption, 0 AS severity
  UNION ALL SELECT c.corruption, s.severity FROM
    (SELECT 'pull' AS corruption UNION ALL SELECT 'shift' UNION ALL SELECT 'same') c
    CROSS JOIN (SELECT 1 AS severity UNION ALL SELECT 2 UNION ALL SELECT 3
                UNION ALL SELECT 4 UNION ALL SELECT 5) s) g
WHERE t.split = 'test'
"""

VIEWS["emb"] = """
SELECT concat('v', CAST(vec_id AS STRING)) AS image_id,
  concat('c', CAST(label % 5 AS STRING)) AS category,
  CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label,
  CASE WHEN label < 5 AND vec_id % 2 = 0 THEN 'train' ELSE 'test' END AS split,
  embedding, vec_id
FROM {embeddings}
"""

VIEWS["gen"] = """
SELECT concat('g', CAST(conv_id AS STRING)) AS image_id, CAST(turn AS INT) AS sample_idx,
  CASE WHEN (conv_id + turn) % 11 = 0 THEN text ELSE
    concat('OBSERVATION:', chr(10), text, chr(10),
    'DEFECT_TYPE:', chr(10),
    CASE (conv_id + turn) % 4 WHEN 0 THEN 'crack' WHEN 1 THEN 'Cracked' WHEN 2 THEN 'hole' ELSE 'NONE' END,
    chr(10), 'DEFECT_LOCATION:', chr(10),
    CASE conv_id % 5 WHEN 0 THEN 'upper left' WHEN 1 THEN 'bottom right corner'
      WHEN 2 THEN 'along the outer edge' WHEN 3 THEN 'across the entire surface' ELSE 'NONE' END,
    chr(10), 'CONFIDENCE: **', CASE turn % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END,
    '**', chr(10), 'ANSWER: ', CASE WHEN (conv_id * 3 + turn * turn) % 5 < 2 THEN 'YES' ELSE 'NO' END)
  END AS text, conv_id, turn
FROM {conversations}
"""

VIEWS["paths"] = """
SELECT concat('/data/', category, '/', split, '/', CASE label WHEN 0 THEN 'good' ELSE
    CASE event_no % 3 WHEN 0 THEN 'scratch' ELSE 'hole' END END, '/', CAST(event_no AS STRING),
    CASE event_no % 7 WHEN 0 THEN '.jpg' WHEN 1 THEN '.txt' ELSE '.png' END) AS path
FROM {evt}
"""

# Mask files of the non-good paths, in the three accepted spellings.
VIEWS["maskpaths"] = """
SELECT concat('/data/', category, '/ground_truth/',
    CASE event_no % 3 WHEN 0 THEN 'scratch' ELSE 'hole' END, '/', CAST(event_no AS STRING),
    CASE event_no % 5 WHEN 0 THEN '.png' WHEN 1 THEN '_mask.jpg' ELSE '_mask.png' END) AS path
FROM {evt} WHERE label = 1 AND event_no % 10 <> 9
UNION ALL
SELECT concat('/data/', category, '/ground_truth/',
    CASE event_no % 3 WHEN 0 THEN 'scratch' ELSE 'hole' END, '/', CAST(event_no AS STRING),
    '.png') AS path
FROM {evt} WHERE label = 1 AND event_no % 4 = 2
"""

# Text templates: the mean vector of every fifth vector of a label.
VIEWS["txt"] = """
SELECT concat('c', CAST(label % 5 AS STRING)) AS category,
  CASE WHEN label >= 5 THEN 'anomaly' ELSE 'normal' END AS polarity, template_idx,
  transform(array_sort(collect_list(struct(i, m))), x -> x.m) AS embedding
FROM (SELECT label, CAST(vec_id % 5 AS INT) AS template_idx, i, avg(CAST(x AS DOUBLE)) AS m
      FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS i, x GROUP BY 1, 2, 3) t
GROUP BY label, template_idx
"""
DUCK_VIEWS["txt"] = """
SELECT concat('c', CAST(label % 5 AS STRING)) AS category,
  CASE WHEN label >= 5 THEN 'anomaly' ELSE 'normal' END AS polarity, template_idx,
  list(m ORDER BY i) AS embedding
FROM (SELECT label, CAST(vec_id % 5 AS INT) AS template_idx, i, avg(x) AS m
      FROM (SELECT label, vec_id, CAST(unnest(embedding) AS DOUBLE) AS x,
              generate_subscripts(embedding, 1) AS i FROM {embeddings}) e GROUP BY 1, 2, 3) t
GROUP BY label, template_idx
"""

# Nine 16-dimensional windows per image, on the 9-box grid of a 32 x 32 image.
VIEWS["win"] = """
SELECT image_id, category, label, split, window_idx,
  struct(x0 AS l, y0 AS t, x0 + 16 AS r, y0 + 16 AS b) AS box,
  slice(embedding, 6 * window_idx + 1, 16) AS embedding
FROM (SELECT *, 8 * (window_idx % 3) AS x0, CAST(8 * floor(window_idx / 3) AS INT) AS y0
      FROM {emb} LATERAL VIEW explode(sequence(0, 8)) w AS window_idx) t
"""
DUCK_VIEWS["win"] = """
SELECT image_id, category, label, split, window_idx, x0, y0,
  list_slice(embedding, 6 * window_idx + 1, 6 * window_idx + 16) AS embedding
FROM (SELECT *, 8 * (window_idx % 3) AS x0, 8 * (window_idx // 3) AS y0
      FROM (SELECT *, unnest(range(9)) AS window_idx FROM {emb}) w) t
"""

# Tokens of each generation with log-probabilities of the two verdicts.
VIEWS["tok"] = """
SELECT concat(image_id, '-', CAST(sample_idx AS STRING)) AS gen_id, pos, token,
  array(-0.1D * ((conv_id + pos) % 7 + 1), -0.3D * (pos % 5 + 1)) AS yes_logprobs,
  array(-0.2D * ((conv_id * 3 + pos) % 5 + 1), -0.25D * (turn % 3 + 1)) AS no_logprobs
FROM {gen} LATERAL VIEW posexplode(split(text, '[ \\\\n]+')) e AS pos, token
"""
DUCK_VIEWS["tok"] = """
SELECT gen_id, pos, token, [-0.1::DOUBLE * ((conv_id + pos) % 7 + 1), -0.3::DOUBLE * (pos % 5 + 1)] AS yes_logprobs,
  [-0.2::DOUBLE * ((conv_id * 3 + pos) % 5 + 1), -0.25::DOUBLE * (turn % 3 + 1)] AS no_logprobs
FROM (SELECT concat(image_id, '-', CAST(sample_idx AS STRING)) AS gen_id, conv_id, turn,
        unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos
      FROM (SELECT *, regexp_split_to_array(text, '[ \\n]+') AS w FROM {gen}) g) t
"""

# 32 x 32 masks: an 8 x 8 block per anomalous image, and a second 2 x 2 block for every third.
_MASK = """CASE WHEN label = 1 AND ((r >= 4 + vec_id % 16 AND r < 12 + vec_id % 16
    AND c >= 4 + sh AND c < 12 + sh) OR (vec_id % 3 = 0 AND r >= 29 AND r < 31 AND c >= 29 AND c < 31))
  THEN 1 ELSE 0 END"""
_SHIFT = "CAST(floor(vec_id / CAST(16 AS DOUBLE)) AS BIGINT) % 16"
VIEWS["masks"] = f"""
SELECT image_id, 32 AS h, 32 AS w, transform(sequence(0, 1023), i ->
  CAST({_MASK.replace("r ", "CAST(floor(i / 32) AS INT) ").replace("c ", "(i % 32) ")} AS TINYINT)) AS mask
FROM (SELECT *, {_SHIFT} AS sh FROM {{emb}}) t WHERE label = 1
"""
VIEWS["maps"] = """
SELECT image_id, category, label, vec_id, k.map_kind, 32 AS h, 32 AS w,
  transform(sequence(0, 1023), i -> CASE k.map_kind
    WHEN 'bank' THEN CAST((vec_id * 31 + CAST(floor(i / 32) AS INT) * 17 + (i % 32) * 13) % 97 AS DOUBLE) / 97D
    ELSE CAST((vec_id * 7 + CAST(floor(i / 32) AS INT) * 5 + (i % 32) * 29) % 89 AS DOUBLE) / 89D END
    + CASE k.map_kind WHEN 'bank' THEN 0.5D ELSE 0.2D END * coalesce(m.mask[i], 0)) AS values
FROM {emb} LEFT JOIN {masks} m USING (image_id)
  LATERAL VIEW explode(array('bank', 'text')) k AS map_kind
"""
# The same in pixel rows.
DUCK_VIEWS["pix"] = f"""
SELECT *, CAST((vec_id * 31 + r * 17 + c * 13) % 97 AS DOUBLE) / 97::DOUBLE + 0.5::DOUBLE * m AS vb,
  CAST((vec_id * 7 + r * 5 + c * 29) % 89 AS DOUBLE) / 89::DOUBLE + 0.2::DOUBLE * m AS vt
FROM (SELECT *, {_MASK} AS m FROM (
  SELECT *, i // 32 AS r, i % 32 AS c FROM (
    SELECT image_id, category, label, split, vec_id, {_SHIFT} AS sh, unnest(range(1024)) AS i FROM {{emb}}) a) b) t
"""

# Records with a stated location and a plain decision.
VIEWS["claims"] = """
SELECT image_id, category, label, vec_id, 'boundary' AS conformal_mode, (vec_id % 29 <> 3) AS parse_ok,
  anomaly_score, CASE WHEN anomaly_score > 0.5 THEN 1 ELSE 0 END AS conformal_pred,
  (CASE WHEN anomaly_score > 0.5 THEN 1 ELSE 0 END) = label AS correct,
  CAST((vec_id * 53) % 211 AS DOUBLE) / CAST(211 AS DOUBLE) AS u_a,
  CAST((vec_id * 29 + label * 40) % 173 AS DOUBLE) / CAST(173 AS DOUBLE) AS u_conformal,
  CASE vec_id % 8 WHEN 0 THEN 'upper left corner' WHEN 1 THEN 'Top-right area' WHEN 2 THEN 'along the edge'
    WHEN 3 THEN 'across the entire surface' WHEN 4 THEN 'in the center' WHEN 5 THEN 'NONE'
    WHEN 6 THEN 'somewhere odd' ELSE 'bottom' END AS predicted_location
FROM (SELECT *, CAST((vec_id * 37) % 101 AS DOUBLE) / CAST(101 AS DOUBLE) * CAST(0.6 AS DOUBLE)
        + CAST(0.3 AS DOUBLE) * label AS anomaly_score FROM {emb}) t
"""

_NAME = re.compile(r"\{(\w+)\}")


def _needs(text: str) -> list[str]:
    out: list[str] = []
    for name in _NAME.findall(text):
        if name not in out:
            out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the parquet tables in ``sf_dir``."""
    text = VIEWS[name]
    inputs = {need: table(spark, sf_dir, need) if need in TABLES
              else spark_view(spark, sf_dir, need) for need in _needs(text)}
    return spark.sql(text, **inputs)


def cte(body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """``body`` preceded by the WITH clauses of every view it names as ``{view}``."""
    texts = {**VIEWS, **DUCK_VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for need in _needs(texts[name]):
            if need != name:
                visit(need)
        order.append(name)

    for name in _needs(body):
        visit(name)

    def plain(text: str) -> str:
        return _NAME.sub(lambda m: m.group(1), text).strip()

    head = ",\n".join(f"{n} AS (\n{plain(texts[n])}\n)" for n in order)
    word = "WITH RECURSIVE" if recursive else "WITH"
    return f"{word} {head}\n{plain(body)}" if order else plain(body)
