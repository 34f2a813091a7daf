"""SQL fragments shared by the oracles."""

from __future__ import annotations

D = 0.05


def sql_rank(n: str, delta: float = D) -> str:
    return f"CAST(ceil(({n} + 1) * (1.0::DOUBLE - {delta}::DOUBLE)) AS BIGINT)"


def sql_clip(p: str) -> str:
    return f"least(greatest({p}, 1e-12::DOUBLE), 1.0::DOUBLE - 1e-12::DOUBLE)"


def sql_mode(p: str, mode: str, delta: float = D, tau: float = 1.0) -> str:
    c, d = sql_clip(p), f"{delta}::DOUBLE"
    if mode == "symmetric":
        v = f"1.0::DOUBLE - 2.0::DOUBLE * abs({c} - 0.5::DOUBLE)"
    elif mode == "entropy":
        v = f"-({c} * log2({c}) + (1.0::DOUBLE - {c}) * log2(1.0::DOUBLE - {c}))"
    elif mode == "log":
        v = f"exp(-abs(ln({c} / {d})) / {tau}::DOUBLE)"
    else:
        v = (f"1.0::DOUBLE - 2.0::DOUBLE * abs(CASE WHEN {c} <= {d} THEN 0.5::DOUBLE * {c} / {d} ELSE "
             f"0.5::DOUBLE + 0.5::DOUBLE * ({c} - {d}) / (1.0::DOUBLE - {d}) END - 0.5::DOUBLE)")
    return f"CASE WHEN {p} IS NOT NULL THEN {v} END"


def sql_u01(*keys: str) -> str:
    text = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(concat('0x', substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def sql_thr(source: str, delta: float = D, score: str = "anomaly_score",
            group: str = "category") -> str:
    """(group, n_cal, threshold) of the finite scores in ``source``."""
    return f"""SELECT {group}, max(n) AS n_cal,
  coalesce(max(CASE WHEN rn = {sql_rank('n', delta)} THEN s END), 'inf'::DOUBLE) AS threshold
  FROM (SELECT {group}, {score} AS s, row_number() OVER (PARTITION BY {group} ORDER BY {score}) AS rn,
          count(*) OVER (PARTITION BY {group}) AS n
        FROM {source} WHERE {score} IS NOT NULL) r GROUP BY {group}"""


def sql_scored(records: str, cal: str = "{cal}", thr: str = "{thr}", where: str = "split = 'test'",
               extra: str = "") -> str:
    """Calibrated test rows: conformal_p, conformal_pred, u_conformal, correct."""
    return f"""
SELECT t.*, CASE WHEN t.anomaly_score IS NOT NULL AND t.anomaly_score > c.threshold THEN 1 ELSE 0 END
    AS conformal_pred, t.conformal_p0 AS conformal_p,
  {sql_mode('t.conformal_p0', 'boundary')} AS u_conformal,
  (CASE WHEN t.anomaly_score IS NOT NULL AND t.anomaly_score > c.threshold THEN 1 ELSE 0 END) = t.label
    AS correct
FROM (
  SELECT image_id, category, label, parse_ok, anomaly_score {extra},
    (1.0::DOUBLE + CASE WHEN anomaly_score IS NULL THEN 0 ELSE ge END) / (n + 1.0::DOUBLE) AS conformal_p0
  FROM (
    SELECT x.*, sum(is_cal) OVER (PARTITION BY category ORDER BY anomaly_score DESC NULLS LAST
        RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ge,
      sum(CASE WHEN anomaly_score IS NOT NULL THEN is_cal ELSE 0 END) OVER (PARTITION BY category) AS n
    FROM (
      SELECT image_id, category, label, parse_ok, anomaly_score {extra}, 0 AS is_cal FROM {records} WHERE {where}
      UNION ALL
      SELECT image_id, category, label, parse_ok, anomaly_score {extra}, 1 FROM {cal}
    ) x
  ) y WHERE is_cal = 0
) t JOIN {thr} c ON c.category = t.category
"""


P: dict[str, str] = {}
P["cal"] = "SELECT * FROM {evt} WHERE split = 'train' AND label = 0 AND anomaly_score IS NOT NULL"
P["thr"] = sql_thr("{cal}")
P["scored"] = sql_scored("{evt}", extra=", event_no")
P["signals"] = f"""
SELECT s.*,
  {sql_mode('conformal_p', 'log')} AS u_conformal_log,
  CASE WHEN parse_ok THEN round(-({sql_clip('anomaly_score')} * log2({sql_clip('anomaly_score')})
    + (1.0::DOUBLE - {sql_clip('anomaly_score')}) * log2(1.0::DOUBLE - {sql_clip('anomaly_score')})), 9)
    ELSE 1.0::DOUBLE END AS u_token_entropy,
  CASE WHEN anomaly_score IS NOT NULL THEN round(sqrt(greatest(anomaly_score * (1.0::DOUBLE - anomaly_score),
    0.0::DOUBLE)), 9) END AS u_verdict_var,
  CASE WHEN parse_ok THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS u_abstention
FROM {{scored}} s
"""


def sql_fan(source: str) -> str:
    """Rows of ``source`` once under their category and once under POOLED, as ``grp``."""
    return (f"(SELECT category AS grp, * FROM {source} UNION ALL "
            f"SELECT 'POOLED' AS grp, * FROM {source})")


def sql_auroc(source: str, group: str, score: str, label: str) -> str:
    """(group, n, n_pos, auroc, aupr) over the finite scores of ``source``."""
    return f"""
SELECT {group}, n, n_pos,
  CASE WHEN n_pos > 0 AND n > n_pos THEN u / (n_pos * (n - n_pos))::DOUBLE END AS auroc,
  CASE WHEN n_pos > 0 AND n > n_pos THEN ap / n_pos END AS aupr
FROM (
  SELECT {group}, CAST(sum(c) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS n_pos,
    sum(p * (nb + (c - p) / 2.0::DOUBLE)) AS u, sum(p * tp::DOUBLE / al) AS ap
  FROM (
    SELECT {group}, s, c, p,
      coalesce(sum(c - p) OVER (PARTITION BY {group} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS nb,
      sum(p) OVER (PARTITION BY {group} ORDER BY s DESC) AS tp,
      sum(c) OVER (PARTITION BY {group} ORDER BY s DESC) AS al
    FROM (SELECT {group}, {score} AS s, count(*) AS c, sum({label}) AS p
          FROM {source} WHERE {score} IS NOT NULL GROUP BY {group}, {score}) q
  ) r GROUP BY {group}
) z
"""


def sql_curve(source: str, group: str, u: str, correct: str = "correct",
              abstain: str = "NOT parse_ok", row: str = "image_id") -> str:
    """Risk-coverage rows of ``source`` (columns k, n, e, coverage, risk)."""
    return f"""
SELECT {group}, {row}, k, n, e, k::DOUBLE / n AS coverage, ce::DOUBLE / k AS risk,
  greatest(k - (n - e), 0)::DOUBLE / k AS oracle
FROM (
  SELECT {group}, {row}, row_number() OVER w AS k, sum(err) OVER w AS ce,
    count(*) OVER (PARTITION BY {group}) AS n, sum(err) OVER (PARTITION BY {group}) AS e
  FROM (SELECT {group}, {row}, 1 - CAST({correct} AS INT) AS err,
          CASE WHEN {u} IS NULL OR {abstain} THEN 'inf'::DOUBLE ELSE {u} END AS ukey FROM {source}) q
  WINDOW w AS (PARTITION BY {group} ORDER BY ukey, {row} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
) r
"""


def sql_unpivot(source: str, keys: str, signals: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{s}' AS signal, {s} AS value FROM {source}" for s in signals)
