import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surety.plans import joins, sketch
from surety.functions.columns import uniform
from surety.plans.joins import attach_cells
from surety.plans.ranking import (prefix_sums, quantiles, ranged, ranked_cells,
                                   ranked_parts, running_sums)
from surety.plans.replicates import poisson_weights
from surety.plans.sketch import first_rows
from surety.operators.inference import holm, paired_bootstrap, spearman
from surety.operators import selective
from surety.operators.metrics import calibration_errors, rank_metrics


def rows(n=400, seed=1, levels=None):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        # One group holds most rows and one value holds a third of them.
        group = "hot" if rng.random() < 0.8 else f"g{i % 3}"
        label = int(rng.random() < 0.3)
        s = 0.5 if rng.random() < 0.33 else rng.random() * 0.7 + 0.3 * label
        if levels:
            s = round(s * levels) / levels
        out.append((f"r{i}", group, label, s))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "image_id string, category string, label int, s double")


def brute_auroc(pos, neg):
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_prefix_sums_span_partitions(spark):
    data = [("a", float(i), 1) for i in range(300)] + [("b", float(i), 2) for i in range(50)]
    df = spark.createDataFrame(data, "g string, x double, n int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = ranged(df, ["g"], ["x"])
        assert parts.select("_pid").distinct().count() > 1
        out = prefix_sums(df, ["g"], ["x"], ["n"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) == 350
    for r in out:
        step = 1 if r["g"] == "a" else 2
        assert r["n_before"] == step * r["x"]
        assert r["n_total"] == (300 if r["g"] == "a" else 100)


def test_metrics_against_brute_force(spark):
    data = rows(levels=12)
    got = {r["category"]: r for r in rank_metrics(frame(spark, data), ["category"], "s").collect()}
    for group in {d[1] for d in data}:
        pos = [d[3] for d in data if d[1] == group and d[2] == 1]
        neg = [d[3] for d in data if d[1] == group and d[2] == 0]
        assert got[group]["auroc"] == pytest.approx(brute_auroc(pos, neg))


def test_nan_null_and_inf_scores_are_left_out(spark):
    data = [("a", "g", 1, 0.9), ("b", "g", 0, 0.1), ("c", "g", 1, float("nan")),
            ("d", "g", 0, None), ("e", "g", 0, float("inf"))]
    r = rank_metrics(frame(spark, data), ["category"], "s").first()
    assert (r["n"], r["n_pos"], r["auroc"]) == (2, 1, 1.0)


def test_single_class_is_unknown(spark):
    r = rank_metrics(frame(spark, [("a", "g", 1, 0.2), ("b", "g", 1, 0.3)]), ["category"],
                     "s").first()
    assert r["auroc"] is None and r["aupr"] is None


def test_quantiles_match_numpy(spark):
    data = rows()
    q = {"lo": 0.1, "mid": 0.5, "hi": 0.97}
    got = {r["category"]: r for r in quantiles(ranked_cells(
        frame(spark, data), ["category"], "s", {"n": F.lit(1)}), ["category"], "s", q).collect()}
    for group in {d[1] for d in data}:
        values = [d[3] for d in data if d[1] == group]
        for name, p in q.items():
            assert got[group][name] == pytest.approx(np.quantile(values, p))


def test_hot_key_join_gives_the_same_rows(spark, monkeypatch):
    df = frame(spark, rows())
    ranking, parts = ranked_parts(df, ["category"], "s", {"n": F.lit(1)})
    cells = ranking.select("category", "s", "n", "n_before")
    plain = sorted(map(tuple, attach_cells(df, cells, parts, ["category", "s"]).collect()))
    monkeypatch.setattr(joins, "SHARE_ROWS", 50)
    salted = attach_cells(df, cells, parts, ["category", "s"])
    assert "_shares" in salted._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, salted.select("category", "s", "image_id", "label", "n_before")
                      .collect())) == plain


def test_first_rows_of_any_size_are_one_path(spark):
    df = frame(spark, rows())
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r["s"] is not None, r["s"] or 0, r["image_id"])):
        want.setdefault(r["category"], []).append(r["image_id"])
    few = first_rows(df, ["category"], ["s", "image_id"], 40, "p")
    assert few.columns == [*df.columns, "p"]
    got = sorted((r["category"], r["p"], r["image_id"]) for r in few.collect())
    assert got == sorted((g, k + 1, i) for g, ids in want.items() for k, i in enumerate(ids[:40]))


def test_broadcast_is_bounded_by_bytes(spark):
    wide = spark.range(10).selectExpr("id", "array_repeat(array_repeat(1.0D, 100), 20) as v")

    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(joins.bounded(wide)) and not hinted(joins.bounded(wide, 100_000))
    size = wide.agg(F.sum(joins.row_bytes(wide.schema))).first()[0]
    assert 160_000 < size < 200_000


def test_missing_keys_keep_their_rows(spark):
    data = [(str(i), None if i % 4 == 0 else "g", None if i % 3 == 0 else (float("nan") if i % 7 == 0 else 0.5)) for i in range(40)]
    df = spark.createDataFrame(data, "image_id string, category string, s double").withColumn("a.b", F.lit(1))
    ranking, parts = ranked_parts(df, ["category"], "s", {"n": F.lit(1)})
    out = attach_cells(df, ranking.select("category", "s", "n", "n_before"), parts, ["category", "s"])
    assert out.count() == 40
    matched = sum(1 for _, c, s in data if c is not None and s is not None and s == s)
    assert out.where("n_before is not null").count() == matched


def test_first_rows_keep_null_groups_at_every_size(spark):
    data = [(str(i), None if i % 5 == 0 else "g", i % 7 / 7.0) for i in range(50)]
    df = spark.createDataFrame(data, "image_id string, category string, s double")
    small, large = (first_rows(df, ["category"], ["s", "image_id"], n, "p") for n in (1000, 1001))
    assert small.schema == large.schema
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert small.count() == 50 and small.where("category is null").agg({"p": "max"}).first()[0] == 10


def test_running_sums_need_no_second_shuffle(spark):
    df = frame(spark, rows()).withColumn("w", F.col("s") * 0.1)
    parts = ranged(df, ["category"], ["s", "image_id"])
    plan = running_sums(parts, ["category"], ["w"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_ece_of_constant_scores(spark):
    data = [(str(i), "g", int(i < 3), 0.5) for i in range(10)]
    r = calibration_errors(frame(spark, data), ["category"], score="s").first()
    assert r["ece_adaptive"] == pytest.approx(0.2)


def test_poisson_weights_have_the_right_law():
    keys = np.arange(2000, dtype=np.int64)
    for n in (1, 7, 64, 65, 200, 100_000):
        w = poisson_weights(keys, np.full(2000, n), 50, 3)
        assert w.mean() == pytest.approx(n, rel=0.03)
        assert w.var() == pytest.approx(n, rel=0.05)
    again = poisson_weights(keys[5:9], np.full(4, 7), 50, 3)
    assert (again == poisson_weights(keys, np.full(2000, 7), 50, 3)[5:9]).all()


def test_identical_scorers_do_not_differ(spark):
    df = frame(spark, rows(200)).select("image_id", "category", "label",
                                        F.col("s").alias("score_a"), F.col("s").alias("score_b"))
    r = paired_bootstrap(df, [], n_boot=30).first()
    assert r["diff"] == 0.0 and r["p_value"] == 1.0


def test_holm_steps_down(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005),
                                ("e", None)], "t string, p double")
    got = {r["t"]: r["significant_holm"] for r in holm(df, "p", "t").collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True, "e": False}


def test_spearman_edge_cases(spark):
    df = spark.createDataFrame(
        [("up", float(i), float(i * i)) for i in range(5)]
        + [("flat", float(i), 1.0) for i in range(5)] + [("few", 1.0, 2.0), ("few", 2.0, 1.0)],
        "g string, x double, y double")
    got = {r["g"]: r["rho"] for r in spearman(df, ["g"], "x", "y").collect()}
    assert got["up"] == pytest.approx(1.0) and got["flat"] is None and got["few"] is None


def first_of(rows, group, n, key):
    """First rows of each group in plain Python."""
    found = {}
    for r in sorted(rows, key=key):
        found.setdefault(r[group], []).append(r)
    return {g: v[:n] for g, v in found.items()}


@pytest.mark.parametrize("held", [7, 100_000])
@pytest.mark.parametrize("n", [1, 5, 2000])
def test_sketches_hold_the_first_rows(spark, monkeypatch, held, n):
    """A hot group, ties, NULL and NaN in the order, NULL groups, many groups of one row."""
    monkeypatch.setattr(sketch, "HELD_ROWS", held)
    rng = random.Random(8)
    data = [(i, rng.choice(["hot", "hot", "hot", None, f"g{i}"]), rng.choice([None, float("nan"), 0.25, rng.random()])) for i in range(600)]
    df = spark.createDataFrame(data, "i int, g string, x double").repartition(7)
    want = first_of(data, 1, n, lambda r: (0, 0, r[0]) if r[2] is None else (2, 0, r[0]) if r[2] != r[2] else (1, r[2], r[0]))
    got = {}
    for r in first_rows(df, ["g"], ["x", "i"], n, "p").collect():
        got.setdefault(r["g"], []).append((r["p"], r["i"]))
    assert {g: sorted(v) for g, v in got.items()} == {g: [(k + 1, r[0]) for k, r in enumerate(v)] for g, v in want.items()}


def test_first_rows_store_and_range_nothing(spark):
    """Rows are pruned in the task that reads them; no range partitioning, no stored table."""
    df = spark.range(0, 5000, 1, 8).selectExpr("id % 3 as g", "hash(id) as h", "id")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    out = first_rows(df, ["g"], ["h", "id"], 10)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == jobs
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "ExistingRDD" not in plan and plan.count("MapInArrow") == 2
    assert out.count() == 30


def test_draws_of_every_size_in_one_pass(spark):
    df = spark.range(300).selectExpr("case when id % 10 = 0 then 'rare' else 'hot' end as g", "cast(id as string) as image_id")
    orders = [uniform(F.lit(rep), "image_id") for rep in range(3)]
    got = sketch.draws(df, ["g"], orders, "image_id", 20)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 2
    found = {}
    for r in got.collect():
        found.setdefault((r["rep"], r["g"]), []).append((r[sketch.DRAW], r["image_id"]))
    for rep in range(3):
        rows = df.withColumn("u", uniform(rep, "image_id")).collect()
        for g, want in first_of([tuple(r) for r in rows], 0, 20, lambda r: (r[2], r[1])).items():
            assert sorted(found[rep, g]) == [(k + 1, r[1]) for k, r in enumerate(want)]


def test_rows_meet_their_offsets_where_they_are(spark):
    """What stands before a partition is a small table: ranked rows are not shuffled to join it."""
    rows = spark.createDataFrame([(["a", "b", None][i % 3], i * 7 % 50, i) for i in range(300)], "g string, v int, i int").withColumn("n", F.lit(1))
    found = prefix_sums(rows, ["g"], ["v", "i"], ["n"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    for g in ("a", "b", None):
        places = sorted((r.v, r.i, r.n_before, r.n_total) for r in found.collect() if r.g == g)
        assert [p[2:] for p in places] == [(k, 100) for k in range(100)]


def test_an_unnamed_curve_keeps_its_order_and_stores_no_row_ids(spark):
    """The area of a curve needs the order of its rows, not their ids."""
    rows = spark.createDataFrame([("g" + str(i % 2), f"r{i * 13 % 80:02d}", [0.1, 0.5, None][i % 3], [True, False, True, None][i % 4]) for i in range(80)],
                                 "g string, image_id string, u double, correct boolean")
    named, short = (selective.risk_coverage(rows, ["g"], "u", named=x) for x in (True, False))
    assert "image_id" in named.columns and "image_id" not in short.columns and "_u" not in short.columns
    columns = ["g", "k", "coverage", "risk", "n", "n_errors"]
    assert short.columns == columns
    assert sorted(map(str, named.select(columns).collect())) == sorted(map(str, short.collect()))
    assert "image_id" not in short._jdf.queryExecution().analyzed().toString()
