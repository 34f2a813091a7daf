import random

import pytest
from pyspark.sql import functions as F

from surety.functions.columns import calibration_sd, pvalue_uncertainty
from surety.operators import conformal, prediction_sets, temperature

SCHEMA = "image_id string, category string, label int, split string, anomaly_score double, parse_ok boolean"


def pool(spark, n=100, group="g"):
    return spark.createDataFrame([(f"c{group}{i}", group, 0, "train", float(i), True)
                                  for i in range(1, n + 1)], SCHEMA)


def test_threshold_is_the_corrected_order_statistic(spark):
    r = conformal.thresholds(pool(spark), [0.05]).first()
    assert r["threshold"] == 96.0 and r["n_cal"] == 100


def test_small_pool_cannot_certify(spark):
    assert conformal.thresholds(pool(spark, 5), [0.05]).first()["threshold"] == float("inf")


def test_bad_delta_and_anomalous_rows_raise(spark):
    with pytest.raises(ValueError):
        conformal.thresholds(pool(spark), [1.5])
    with pytest.raises(ValueError, match="normal-only"):
        conformal.calibration_pool(pool(spark).withColumn("label", F.lit(1)))


def test_missing_group_raises(spark):
    model = conformal.MondrianConformal().fit(pool(spark))
    with pytest.raises(ValueError, match="no calibration data"):
        model.transform(pool(spark, 3, "other"))


def test_odd_scores(spark):
    test = spark.createDataFrame(
        [("a", "g", 1, "test", 96.5, True), ("b", "g", 0, "test", float("nan"), False),
         ("c", "g", 0, "test", None, False), ("d", "g", 0, "test", float("inf"), True),
         ("e", "g", 0, "test", -float("inf"), True), ("f", "g", 0, "test", 96.0, True)], SCHEMA)
    rows = {r["image_id"]: r for r in conformal.calibrate(pool(spark).unionByName(test))[0]
            .collect()}
    assert rows["a"]["conformal_p"] == 5 / 101 and rows["a"]["conformal_pred"] == 1
    for missing in "bc":
        assert rows[missing]["conformal_p"] == 1 / 101
        assert rows[missing]["conformal_pred"] == 0 and rows[missing]["correct"]
    assert rows["d"]["conformal_p"] == 1 / 101 and rows["d"]["conformal_pred"] == 1
    assert rows["e"]["conformal_p"] == 1.0
    assert rows["f"]["conformal_pred"] == 0


def test_modes(spark):
    df = spark.createDataFrame([(0.05,), (0.5,), (None,)], "p double")
    b = [r[0] for r in df.select(pvalue_uncertainty(F.col("p"), "boundary", 0.05)).collect()]
    s = [r[0] for r in df.select(pvalue_uncertainty(F.col("p"), "symmetric")).collect()]
    assert b[0] == pytest.approx(1.0) and s[1] == pytest.approx(1.0)
    assert b[2] is None and s[2] is None
    with pytest.raises(ValueError):
        pvalue_uncertainty(F.col("p"), "log", tau=0)
    with pytest.raises(KeyError):
        pvalue_uncertainty(F.col("p"), "nope")


def test_calibration_sd(spark):
    sd = spark.range(1).select(calibration_sd(F.lit(200), 0.10),
                               calibration_sd(F.lit(200), 0.05),
                               calibration_sd(F.lit(5), 0.05)).first()
    assert sd[0] == pytest.approx(0.0211, abs=2e-4)
    assert sd[1] == pytest.approx(0.0153, abs=2e-4) and sd[2] is None


def test_coverage_holds_on_exchangeable_rows(spark):
    rng = random.Random(3)
    data = [(f"{s}{i}", g, 0, s, rng.random(), True)
            for g in ("a", "b") for s in ("train", "test") for i in range(300)]
    data = [(f"{d[1]}{d[0]}", *d[1:]) for d in data]
    records = spark.createDataFrame(data, SCHEMA)
    test = records.where("split = 'test'")
    model = conformal.MondrianConformal(delta=0.1).fit(records.where("split = 'train'"))
    rows = {r["group"]: r for r in conformal.coverage_report(test, model, n_boot=200).collect()}
    assert set(rows) == {"a", "b", "POOLED"}
    p = rows["POOLED"]
    assert abs(p["empirical_coverage"] - 0.9) < 0.05
    assert p["ci_lo"] <= p["empirical_coverage"] <= p["ci_hi"]
    assert p["ci_lo_total"] <= p["ci_lo"] and p["ci_hi_total"] >= p["ci_hi"]


def test_prediction_sets(spark):
    normal = pool(spark, 100)
    anomalies = spark.createDataFrame([(f"s{i}", "g", 1, "syn", 200.0 + i, True)
                                       for i in range(100)], SCHEMA)
    test = spark.createDataFrame([("low", "g", 0, "test", 50.0, True),
                                  ("gap", "g", 1, "test", 150.0, True),
                                  ("high", "g", 1, "test", 250.0, True)], SCHEMA)
    out = {r["image_id"]: r for r in prediction_sets.prediction_sets(test, normal, anomalies)
           .collect()}
    assert out["low"]["set_label"] == "{normal}" and out["high"]["set_label"] == "{anomalous}"
    assert out["gap"]["set_label"] == "{}" and out["gap"]["set_is_ood"]
    # Without an anomaly pool the anomalous label has no p-value and is rejected.
    none = {r["image_id"]: r for r in prediction_sets.prediction_sets(
        test, normal, anomalies.where("false")).collect()}
    assert none["high"]["p_anomalous"] is None and none["high"]["set_label"] == "{}"


def test_temperature_recovers_the_scale(spark):
    rng = random.Random(5)
    import math
    data = []
    for i in range(4000):
        z = rng.gauss(0, 2)
        data.append((int(rng.random() < 1 / (1 + math.exp(-z))), 1 / (1 + math.exp(-3 * z))))
    df = spark.createDataFrame(data, "label int, anomaly_score double")
    assert temperature.fit_temperature(df) == pytest.approx(3.0, rel=0.15)
    with pytest.raises(ValueError):
        temperature.fit_temperature(df.where("label = 1"))
