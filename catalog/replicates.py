"""SQL of bootstrap replicates: keyed draws repeated with integers modulo 2**64."""

from __future__ import annotations

from surety.plans.replicates import GOLD, NEGATIVE

_WORD = "18446744073709551615::UHUGEINT"


def _times(a: str, b: int) -> str:
    return f"((({a})::UHUGEINT * {b}::UHUGEINT) & {_WORD})"


def _plus(a: str, b: str) -> str:
    return f"((({a})::UHUGEINT + {b}) & {_WORD})::UBIGINT"


def _mixed(x: str, out: str) -> str:
    """Column ``out``: ``x`` through the finaliser, one step a column."""
    return (f"({x})::UBIGINT AS {out}_0, xor({out}_0, {out}_0 >> 30) AS {out}_1, {_times(f'{out}_1', 0xBF58476D1CE4E5B9)}::UBIGINT AS {out}_2, "
            f"xor({out}_2, {out}_2 >> 27) AS {out}_3, {_times(f'{out}_3', 0x94D049BB133111EB)}::UBIGINT AS {out}_4, xor({out}_4, {out}_4 >> 31) AS {out}")


def sql_key(*columns: str) -> str:
    text = f"concat_ws(':', {', '.join(f'CAST({c} AS VARCHAR)' for c in columns)})"
    return f"concat('0x', substr(md5({text}), 1, 15))::BIGINT::UBIGINT"


def sql_uniform(key: str, n_boot: int, source: str, keep: str) -> str:
    """``keep, rep, u``: one uniform number per row of ``source`` and replicate, keyed by ``key``."""
    return f"""SELECT {keep}, rep, (bits >> 11)::DOUBLE * 1.1102230246251565e-16::DOUBLE AS u FROM (
      SELECT *, {_mixed(_plus('start', _times('rep', GOLD)), 'bits')} FROM (
        SELECT *, unnest(range(1, {n_boot + 1})) AS rep FROM (SELECT *, {_mixed(key, 'start')} FROM {source}) a) b) c"""


def sql_weights(strata: str, n_boot: int) -> str:
    """``k, cls, rep, t, w``: how often each replicate draws row ``t`` of a stratum.

    ``strata`` has ``k, cls, n, key``; strata are no larger than one range of direct draws.
    """
    return f"""SELECT k, cls, rep, t, count(*) AS w FROM (
      SELECT k, cls, rep, floor((bits >> 11)::DOUBLE * 1.1102230246251565e-16::DOUBLE * n)::BIGINT AS t FROM (
        SELECT k, cls, n, rep, {_mixed(_plus('r', _times('j', GOLD)), 'bits')} FROM (
          SELECT k, cls, n, rep, r, unnest(range(1, n + 1)) AS j FROM (
            SELECT k, cls, n, rep, {_mixed(_plus('h2', _times('rep', GOLD)), 'r')} FROM (
              SELECT k, cls, n, h2, unnest(range(1, {n_boot + 1})) AS rep FROM (
                SELECT k, cls, n, {_mixed('key', 'h1')}, {_mixed('h1', 'h2')} FROM {strata}) a) b) c) d) e) f GROUP BY ALL"""


def sql_draws(cells: str) -> str:
    """``k, rep, auroc, aupr`` of ``cells(k, rep, s, p, q)``: weights of both classes per score."""
    return f"""SELECT k, rep, sum(p * (nb + q / 2.0::DOUBLE)) / (sum(p) * sum(q))::DOUBLE AS auroc, sum(p * tp::DOUBLE / al) / sum(p)::DOUBLE AS aupr FROM (
      SELECT k, rep, s, p, q, (coalesce(sum(q) OVER lo, 0) - q)::DOUBLE AS nb, sum(p) OVER hi AS tp, sum(p + q) OVER hi AS al FROM {cells}
      WINDOW lo AS (PARTITION BY k, rep ORDER BY s), hi AS (PARTITION BY k, rep ORDER BY s DESC)) q
      GROUP BY k, rep HAVING sum(p) > 0 AND sum(q) > 0"""


def paired_parts(aligned: str, n_boot: int, name: str) -> dict[str, str]:
    """View ``<name>_diff`` (``k, rep, diff``) of ``aligned(grp, image_id, label, score_a, score_b)``."""
    sides = " UNION ALL ".join(f"""SELECT concat(k, '|{side}') AS k, rep, score_{side} AS s, sum(w * label) AS p, sum(w * (1 - label)) AS q
      FROM {{{name}_rows}} r JOIN {{{name}_w}} w USING (k, t) WHERE w.cls = r.label AND score_{side} IS NOT NULL GROUP BY ALL""" for side in "ab")
    return {
        f"{name}_rows": f"""SELECT *, grp AS k, {sql_key('grp', 'label')} AS key, row_number() OVER (PARTITION BY grp, label ORDER BY image_id) - 1 AS t FROM {aligned}""",
        f"{name}_strata": f"SELECT k, label AS cls, count(*) AS n, any_value(key) AS key FROM {{{name}_rows}} GROUP BY ALL",
        f"{name}_w": sql_weights(f"{{{name}_strata}}", n_boot),
        f"{name}_cells": sides,
        f"{name}_draws": sql_draws(f"{{{name}_cells}}"),
        f"{name}_diff": f"""SELECT split_part(k, '|', 1) AS k, rep, max(CASE WHEN k LIKE '%|a' THEN auroc END) - max(CASE WHEN k LIKE '%|b' THEN auroc END) AS diff
          FROM {{{name}_draws}} GROUP BY ALL""",
    }


def stratified_parts(source: str, keys: list[str], score: str, label: str, n_boot: int, name: str) -> dict[str, str]:
    """Views ``<name>_draws`` (``k, rep, auroc, aupr``) and ``<name>_ci`` of the finite scores of ``source``."""
    key = sql_key(*keys)
    k = f"concat_ws(':', {', '.join(f'CAST({c} AS VARCHAR)' for c in keys)})"
    return {
        f"{name}_rows": f"""SELECT *, row_number() OVER (PARTITION BY k, y ORDER BY s) - 1 AS t FROM (
          SELECT {k} AS k, CASE WHEN {label} = 1 THEN {key} ELSE xor({key}, {NEGATIVE}::UBIGINT) END AS key, {score} AS s, ({label})::INT AS y FROM {source} WHERE {score} IS NOT NULL) q""",
        f"{name}_strata": f"SELECT k, y AS cls, count(*) AS n, any_value(key) AS key FROM {{{name}_rows}} GROUP BY ALL",
        f"{name}_w": sql_weights(f"{{{name}_strata}}", n_boot),
        f"{name}_cells": f"""SELECT k, rep, s, sum(w * y) AS p, sum(w * (1 - y)) AS q FROM {{{name}_rows}} r
          JOIN {{{name}_w}} w USING (k, t) WHERE w.cls = r.y GROUP BY ALL""",
        f"{name}_draws": sql_draws(f"{{{name}_cells}}"),
        f"{name}_ci": f"""SELECT k, quantile_cont(auroc, 0.025) AS auroc_ci_lo, quantile_cont(auroc, 0.975) AS auroc_ci_hi,
          quantile_cont(aupr, 0.025) AS aupr_ci_lo, quantile_cont(aupr, 0.975) AS aupr_ci_hi FROM {{{name}_draws}} GROUP BY k""",
    }


def binomial_parts(source: str, hits: str, total: str, n_boot: int, name: str) -> dict[str, str]:
    """View ``<name>_ci`` (``hits, total, ci_lo, ci_hi``): percentiles of keyed binomial shares."""
    return {
        f"{name}_in": f"SELECT DISTINCT {hits}::BIGINT AS hits, {total}::BIGINT AS total FROM {source} WHERE {total} > 0",
        f"{name}_pmf": f"""SELECT hits, total, x, exp(lgamma(total + 1) - lgamma(x + 1) - lgamma(total - x + 1)
            + x * ln(hits::DOUBLE / total) + (total - x) * ln(1.0::DOUBLE - hits::DOUBLE / total)) AS p
          FROM (SELECT *, unnest(range(0, total + 1)) AS x FROM {{{name}_in}} WHERE hits > 0 AND hits < total) q""",
        f"{name}_cdf": f"SELECT hits, total, x, sum(p) OVER (PARTITION BY hits, total ORDER BY x) / sum(p) OVER (PARTITION BY hits, total) AS c FROM {{{name}_pmf}}",
        f"{name}_u": sql_uniform(_plus("hits", _times("total", GOLD)), n_boot, f"{{{name}_in}}", "hits, total"),
        f"{name}_share": f"""SELECT u.hits, u.total, u.rep, CASE WHEN u.hits IN (0, u.total) THEN u.hits::DOUBLE / u.total
          ELSE coalesce(c.x + 1, 0)::DOUBLE / u.total END AS share
          FROM {{{name}_u}} u ASOF LEFT JOIN {{{name}_cdf}} c ON c.hits = u.hits AND c.total = u.total AND c.c <= u.u""",
        f"{name}_ci": f"SELECT hits, total, quantile_cont(share, 0.025) AS ci_lo, quantile_cont(share, 0.975) AS ci_hi FROM {{{name}_share}} GROUP BY ALL",
    }
