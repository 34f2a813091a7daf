"""Replicate weights against plain integers, and every metric against resampled rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from surety.operators import bootstrap
from surety.operators.inference import bootstrap_auroc, paired_bootstrap
from surety.plans import replicates
from surety.plans.replicates import NEGATIVE, Multinomial, poisson_weights, with_weights
from surety.plans.resample import auroc_draws

WORD, GOLD = (1 << 64) - 1, 0x9E3779B97F4A7C15


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & WORD
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & WORD
    return x ^ (x >> 31)


def text_key(*values):
    return int(hashlib.md5(":".join(map(str, values)).encode()).hexdigest()[:15], 16)


def drawn(key, n, n_boot, seed):
    """Counts of direct draws: rows by replicates."""
    start = mix(mix((key + seed * GOLD) & WORD))
    out = np.zeros((n, n_boot), int)
    for rep in range(n_boot):
        r = mix((start + (rep + 1) * GOLD) & WORD)
        for j in range(n):
            bits = mix((r + (j + 1) * GOLD) & WORD)
            out[math.floor((bits >> 11) * 2.0 ** -53 * n), rep] += 1
    return out


def test_direct_draws_are_plain_integers():
    for n in (1, 2, 57):
        got = Multinomial(12345, n, 9, 4).weights(np.arange(n), np.ones(n, int))
        assert (got == drawn(12345, n, 9, 4)).all()


def test_halved_ranges_keep_the_total(monkeypatch):
    """Weights do not depend on which rows a task asks for; totals are exact; the law is multinomial."""
    monkeypatch.setattr(replicates, "LEAF", 8)
    n, n_boot = 1003, 400
    whole = Multinomial(7, n, n_boot, 1).weights(np.arange(n), np.ones(n, int))
    assert (whole.sum(axis=0) == n).all()
    some = np.array([3, 4, 500, 998])
    assert (Multinomial(7, n, n_boot, 1).weights(some, np.array([1, 20, 2, 5])) == [whole[a:a + m].sum(axis=0) for a, m in zip(some, (1, 20, 2, 5))]).all()
    assert whole.mean() == 1 and whole.var() == pytest.approx(1, rel=0.02)
    # Two rows share n draws, so they are correlated by -1 / n; sums of many rows show it.
    assert whole[:500].sum(axis=0).var() == pytest.approx(500 * (1 - 500 / n), rel=0.25)
    assert np.abs(whole.mean(axis=1) - 1).max() < 6 / np.sqrt(n_boot)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    out = []
    for i in range(260):
        group, label = ("hot" if rng.random() < 0.7 else "cold"), int(rng.random() < 0.3)
        score = None if rng.random() < 0.05 else 0.5 if rng.random() < 0.3 else float(rng.random() * 0.7 + 0.3 * label)
        out.append((f"r{i:03d}", group, label, score, None if score is None else float(round(1 - score, 1)), bool(rng.random() < 0.8)))
    return out + [(f"p{i}", "positives", 1, 0.1 * i, 0.5, True) for i in range(5)]


SCHEMA = "image_id string, category string, label int, anomaly_score double, u double, correct boolean"


def auroc(v, pos, neg):
    wins = (v[:, None] > v[None, :]) + 0.5 * (v[:, None] == v[None, :])
    total = pos.sum() * neg.sum()
    return pos @ wins @ neg / total if total else None


@pytest.mark.parametrize("law", ["stratified", "poisson", "given"])
def test_auroc_draws_equal_a_direct_computation(spark, data, law):
    df = spark.createDataFrame(data, SCHEMA).where("anomaly_score is not null").select(
        "category", "image_id", F.col("anomaly_score").alias("value"), F.lit(1).alias("n"), F.col("label").alias("n_pos"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        if law == "given":
            df = with_weights(df, ["category", "n_pos"], "image_id", 20, 5)
            got = auroc_draws(df, ["category"], "value", 20, 5, given="image_id").collect()
        else:
            cells = df.groupBy("category", "value").agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"))
            got = auroc_draws(cells, ["category"], "value", 20, 5, law == "stratified").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = {(r["category"], r["rep"]): r["auroc"] for r in got}
    for group in ("hot", "cold", "positives"):
        rows = sorted(((s, i, y) for i, g, y, s, _, _ in data if g == group and s is not None), key=lambda r: r[0])
        v, y = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
        w, key = np.zeros((len(rows), 20)), text_key(group)
        if law == "given":
            for label in (0, 1):
                order = sorted((i, k) for k, (_, i, z) in enumerate(rows) if z == label)
                w[[k for _, k in order]] = drawn(text_key(group, label), len(order), 20, 5)
        elif law == "stratified":
            w[y == 1], w[y == 0] = drawn(key, int(y.sum()), 20, 5), drawn(key ^ NEGATIVE, int((1 - y).sum()), 20, 5)
        if law == "poisson":
            values, first, n = np.unique(v, return_index=True, return_counts=True)
            n_pos = np.array([y[v == x].sum() for x in values])
            keys = np.array([((key + int(a) * GOLD) & WORD) for a in first], np.uint64).view(np.int64)
            pos, neg, v = poisson_weights(keys, n_pos, 20, 5), poisson_weights(keys ^ np.int64(NEGATIVE), n - n_pos, 20, 5), values
        else:
            pos, neg = w * y[:, None], w * (1 - y)[:, None]
        for rep in range(20):
            want = auroc(v, pos[:, rep], neg[:, rep])
            assert found[group, rep] == (None if want is None else pytest.approx(want))
    if law != "poisson":
        assert all(v is not None for (g, _), v in found.items() if g != "positives")


def test_average_precision_draws(spark, data):
    """Replicates of AUPR, from cells spread over several ranges, equal those of repeated rows."""
    df = spark.createDataFrame(data, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cells = df.where("anomaly_score is not null").groupBy("category", F.col("anomaly_score").alias("value")).agg(
            F.count("*").alias("n"), F.sum("label").alias("n_pos"))
        out = auroc_draws(cells, ["category"], "value", 12, 2, with_ap=True)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {(r["category"], r["rep"]): r["aupr"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "InPandas" not in plan
    rows = sorted(((s, y) for _, g, y, s, _, _ in data if g == "hot" and s is not None))
    v, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    order = np.argsort(v, kind="stable")
    v, y = v[order], y[order]
    w = np.zeros((len(v), 12))
    w[y == 1], w[y == 0] = drawn(text_key("hot"), int(y.sum()), 12, 2), drawn(text_key("hot") ^ NEGATIVE, int((1 - y).sum()), 12, 2)
    for rep in range(12):
        total = 0.0
        for x in np.unique(v):
            at, above = v == x, v >= x
            total += (w[at, rep] * y[at]).sum() * (w[above, rep] * y[above]).sum() / max(w[above, rep].sum(), 1)
        assert got["hot", rep] == pytest.approx(total / (w[:, rep] * y).sum())


def direct(rows):
    """ECE, Brier, coverage and AURC of rows as they are."""
    scored = [(s, y) for _, _, y, s, _, _ in rows if s is not None]
    bins = {}
    for s, y in scored:
        bins.setdefault(min(int(s * 15), 14), []).append((s, y))
    order = sorted(rows, key=lambda r: (math.inf if r[4] is None else r[4], r[0]))
    wrong = np.cumsum([1 - int(r[5]) for r in order])
    return {
        "ece": sum(abs(sum(y for _, y in b) - sum(s for s, _ in b)) for b in bins.values()) / len(scored) if scored else None,
        "brier": sum((s - y) ** 2 for s, y in scored) / len(scored) if scored else None,
        "coverage": sum(r[5] for r in rows) / len(rows),
        "aurc": float(np.mean(wrong / np.arange(1, len(rows) + 1)))}


def all_metrics():
    return {"ece": bootstrap.ece(), "brier": bootstrap.brier(), "coverage": bootstrap.coverage("correct"), "aurc": bootstrap.aurc("u")}


@pytest.mark.parametrize("stratified", [True, False])
def test_any_metric_equals_resampled_rows(spark, data, stratified):
    df = spark.createDataFrame(data, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = bootstrap.bootstrap_draws(df, ["category"], all_metrics(), n_boot=6, seed=9, stratified=stratified).collect()
        ends = bootstrap.bootstrap(df, ["category"], all_metrics(), n_boot=6, seed=9, stratified=stratified).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = {(r["category"], r["metric"], r["rep"]): r["value"] for r in got}
    for group in ("hot", "cold", "positives"):
        mine = sorted(r for r in data if r[1] == group)
        w = np.ones((len(mine), 7), int)
        if stratified:
            for label in {r[2] for r in mine}:
                at = [k for k, r in enumerate(mine) if r[2] == label]
                w[at, 1:] = drawn(text_key(group, label), len(at), 6, 9)
        else:
            w[:, 1:] = poisson_weights(np.array([text_key(r[0]) for r in mine]), np.ones(len(mine), int), 6, 9)
        for rep in range(-1, 6):
            resampled = [r for r, k in zip(mine, w[:, rep + 1]) for _ in range(k)]
            if stratified:
                assert len(resampled) == len(mine) and sum(r[2] for r in resampled) == sum(r[2] for r in mine)
            if resampled:
                for name, value in direct(resampled).items():
                    assert found[group, name, rep] == (None if value is None else pytest.approx(value)), (group, name, rep)
    for r in ends:
        values = [v for (g, m, rep), v in found.items() if (g, m) == (r["category"], r["metric"]) and rep >= 0 and v is not None]
        assert r["ci_lo"] == pytest.approx(np.quantile(values, 0.025)) and r["ci_hi"] == pytest.approx(np.quantile(values, 0.975))


def test_paired_resamples_hold_their_classes(spark, data):
    df = spark.createDataFrame(data, SCHEMA).select("image_id", "category", "label", F.col("anomaly_score").alias("score_a"), F.col("u").alias("score_b"))
    weights = with_weights(df, ["category", "label"], "image_id", 30, 1)
    sums = {}
    for r in weights.collect():
        sums.setdefault((r["category"], r["label"]), []).append(list(r["_w"]))
    assert all((np.sum(v, axis=0) == len(v)).all() for v in sums.values())
    row = paired_bootstrap(df, [], n_boot=30).first()
    assert row["diff_ci_lo"] < row["diff"] < row["diff_ci_hi"]


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert bootstrap.bootstrap(df, ["category"], all_metrics(), n_boot=3).collect() == []
    assert bootstrap_auroc(df, ["category"], n_boot=3).collect() == []


def test_cross_dataset_detection(spark):
    from surety.operators.metrics import cross_dataset_detection, detection_table
    rng = np.random.default_rng(8)

    def side(n, shift, groups):
        label = rng.integers(0, 2, n)
        score = np.round(rng.normal(size=n) + shift * label, 1)
        rows = [(groups[i % len(groups)], float(s), int(y)) for i, (s, y) in enumerate(zip(score, label))]
        return rows + [(groups[0], None, 1), ("one class", 0.5, 0)]

    def auroc(rows):
        pos, neg = ([s for _, s, y in rows if y == k and s is not None] for k in (1, 0))
        return np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    source, target = side(300, 2.0, ["a", "b"]), side(260, 0.5, ["b", "c"])
    schema = "category string, anomaly_score double, label int"
    s, t = spark.createDataFrame(source, schema), spark.createDataFrame(target, schema)
    out = {r["group"]: r for r in cross_dataset_detection(s, t, n_boot=200).collect()}
    assert set(out) == {"a", "b", "c", "one class", "POOLED"}
    for g in ("b", "POOLED"):
        mine = [[r for r in rows if g in ("POOLED", r[0])] for rows in (source, target)]
        a, b = map(auroc, mine)
        assert out[g]["source_auroc"] == pytest.approx(a) and out[g]["target_auroc"] == pytest.approx(b)
        assert out[g]["delta_auroc"] == pytest.approx(b - a)
        assert out[g]["delta_auroc_ci_lo"] < b - a < out[g]["delta_auroc_ci_hi"] < 0
        assert (out[g]["source_n"], out[g]["target_n"]) == tuple(map(len, mine))
    assert out["a"]["target_auroc"] is None and out["a"]["target_n"] is None and out["a"]["delta_auroc_ci_lo"] is None
    assert out["one class"]["source_auroc"] is None and out["one class"]["target_n"] == 1
    points = {r["group"]: r for r in cross_dataset_detection(s, t, n_boot=0).collect()}
    assert points["b"]["delta_aupr"] == pytest.approx(out["b"]["delta_aupr"]) and points["b"]["delta_aupr_ci_lo"] is None
    alone = {r["group"]: r for r in detection_table(s, n_boot=0).collect()}
    assert alone["POOLED"]["auroc"] == pytest.approx(out["POOLED"]["source_auroc"])
    empty = cross_dataset_detection(s.limit(0), t, n_boot=20).where("group = 'POOLED'").first()
    assert empty["source_auroc"] is None and empty["target_auroc"] == pytest.approx(auroc(target))


def test_the_second_pass_over_the_cells_is_made_once(spark):
    """AUROC and AUPR intervals read the same draws: besides it the plan holds two passes for places and points."""
    rows = spark.createDataFrame([("a" if i % 3 else "b", i % 2, (i * 37 % 101) / 101) for i in range(300)], "g string, label int, anomaly_score double")
    both = bootstrap_auroc(rows, ["g"], n_boot=30, seed=5, with_ap=True)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow run") == 3
    one = {r.g: r for r in bootstrap_auroc(rows, ["g"], n_boot=30, seed=5).collect()}
    for r in both.collect():
        assert (r.auroc, r.auroc_ci_lo, r.auroc_ci_hi) == (one[r.g].auroc, one[r.g].auroc_ci_lo, one[r.g].auroc_ci_hi)
        assert r.aupr_ci_lo <= r.aupr <= r.aupr_ci_hi


def test_a_class_of_its_own_has_no_intervals(spark):
    rows = spark.createDataFrame([("a", i % 2, float(i)) for i in range(40)] + [("b", 1, float(i)) for i in range(9)], "g string, label int, anomaly_score double")
    found = {r.g: r for r in bootstrap_auroc(rows, ["g"], n_boot=20, with_ap=True).collect()}
    assert found["a"].auroc_ci_lo is not None and found["a"].aupr_ci_hi is not None
    assert [found["b"][c] for c in ("auroc", "aupr", "auroc_ci_lo", "auroc_ci_hi", "aupr_ci_lo", "aupr_ci_hi")] == [None] * 6
