import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surety.functions.text import location_claim, parse_generation
from surety.operators import (browse, fusion, generations, grounding, maps, neighbours, pixel, report,
                              scoring, selective, semantic, shift, signals)
from surety.operators.neighbours import knn_distance
from surety.plans import joins
from surety.sources import index, records, stores


def test_selective_oracle_order_has_no_excess(spark):
    df = spark.createDataFrame([(f"r{i}", i < 7, float(i >= 7) + i * 1e-3) for i in range(10)],
                               "image_id string, correct boolean, u_x double")
    r = selective.selective_table(df, ["u_x"]).first()
    assert r["eaurc"] == pytest.approx(0.0) and r["n"] == 10
    assert r["acc@cov0.7"] == 1.0 and r["cov@risk0.05"] == pytest.approx(0.7)


def test_abstentions_come_last(spark):
    df = spark.createDataFrame([("a", True, 0.9, True), ("b", False, 0.0, False)],
                               "image_id string, correct boolean, u double, parse_ok boolean")
    curve = selective.risk_coverage(df, [], "u", abstain=~F.col("parse_ok")).orderBy("k").collect()
    assert [r["image_id"] for r in curve] == ["a", "b"]
    assert [r["risk"] for r in curve] == [0.0, 0.5]


TEXTS = [
    ("OBSERVATION: a **deep**\n scratch\nDEFECT_TYPE: scratch\nDEFECT_LOCATION: upper left\n"
     "CONFIDENCE: **HIGH**\nANSWER: **YES**", 1, "HIGH", "upper left"),
    ("looks fine\n\n **No.** \n", 0, "", ""),
    ("I cannot tell", None, "", ""),
    ("answer: no", 0, "", ""),
    ("YES\r\nmaybe", None, "", ""),
    ("", None, "", ""),
]


def test_parse_generation(spark):
    df = spark.createDataFrame([(t,) for t, *_ in TEXTS], "text string")
    out = df.select(*[c.alias(k) for k, c in parse_generation(F.col("text")).items()]).collect()
    for row, (_t, vote, conf, location) in zip(out, TEXTS):
        assert (row["vote"], row["confidence"], row["location"]) == (vote, conf, location)
    assert out[0]["observation"] == "a **deep** scratch"


def test_location_claims(spark):
    cases = {"upper left": "quadrant", "bottom right corner": "corner", "along the edge": "edge",
             "across the entire surface": "surface", "NONE": "none", "": "none",
             "somewhere odd": "unparsed", "in the center": "quadrant", "N/A": "none"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for row in df.select("t", location_claim(F.col("t")).alias("c")).collect():
        assert row["c"]["kind"] == cases[row["t"]], row["t"]
    c = df.where("t = 'upper left'").select(location_claim(F.col("t")).alias("c")).first()["c"]
    assert (c["r0"], c["r1"], c["c0"], c["c1"]) == (0.0, 0.42, 0.0, 0.42)


def tokens(words):
    return [("g", i, w, [-0.1 * (i + 1)], [-1.0]) for i, w in enumerate(words)]


def test_verdict_follows_the_marker(spark):
    schema = "gen_id string, pos int, token string, yes_logprobs array<double>, no_logprobs array<double>"
    split = spark.createDataFrame(tokens(["no", " cracks", " ANS", "WER", ":", " Yes"]), schema)
    assert generations.verdict_probability(split).first()["verdict_pos"] == 5
    bare = spark.createDataFrame(tokens(["no", "x", "yes", "."]), schema)
    assert generations.verdict_probability(bare).first()["verdict_pos"] == 2


def vectors(spark, rows):
    return spark.createDataFrame(rows, "image_id string, category string, embedding array<double>")


def brute_knn(queries, bank, k, unit):
    """Distances by id and group, each a sorted list as ids may repeat."""
    def usable(v):
        return v and all(x is not None and np.isfinite(x) for x in v)

    def scaled(v):
        v = np.array(v)
        return v / max(np.linalg.norm(v), 1e-8) if unit else v
    out = {}
    for i, group, v in queries:
        sims = sorted((float(scaled(v) @ scaled(b)) for _, g, b in bank if g == group and usable(b)), reverse=True)[:k] if usable(v) else []
        out.setdefault((i, group), []).append(1 - sum(sims) / len(sims) if sims else None)
    return {key: sorted(v, key=str) for key, v in out.items()}


@pytest.mark.parametrize("limit", [joins.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("block", [7, 4096])
@pytest.mark.parametrize("unit", [True, False])
def test_knn_matches_brute_force(spark, monkeypatch, limit, block, unit):
    """Clusters, repeated ids, repeated vectors, NULL, NaN, zero and empty vectors, groups without a bank."""
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(0)
    middles = rng.normal(size=(5, 6)) * 3

    def some(n, prefix, group):
        return [(f"{prefix}{i}", group, [float(x) for x in middles[i % 5] + rng.normal(size=6) * 0.3]) for i in range(n)]
    odd = [None, [], [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5, [None] + [1.0] * 5, [0.0] * 6]
    bank = some(60, "b", "hot") + some(3, "c", "small") + [(f"o{i}", "hot", v) for i, v in enumerate(odd)] + [("r", "hot", [1.0] * 6)] * 9
    queries = some(50, "q", "hot") + some(4, "s", "small") + some(2, "n", "none") + [("q1", "hot", [1.0] * 6), ("q1", "hot", [1.0] * 6)]
    queries += [(f"x{i}", "hot", v) for i, v in enumerate(odd)]
    got = {}
    for r in knn_distance(vectors(spark, queries), vectors(spark, bank), ["category"], 5, ["image_id"], "image_id", unit=unit, block=block).collect():
        got.setdefault((r["image_id"], r["category"]), []).append(r["distance"])
    want = brute_knn(queries, bank, 5, unit)
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert sorted(got[key], key=str) == [v if v is None else pytest.approx(v, abs=1e-12) for v in values]


def test_knn_skips_balls(spark):
    """On clustered data less than half of all pairs of vectors is compared."""
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(20, 16))
    rows = [(i, "g", [float(x) for x in middles[i % 20] + rng.normal(size=16) * 0.05]) for i in range(1200)]
    df = spark.createDataFrame(rows, "_rn bigint, category string, _v array<double>")
    bank, queries = df.where("_rn < 800"), df.where("_rn >= 800")
    seen = neighbours.nearest_pairs(queries, bank, ["category"], 5, block=40).agg({"_seen": "sum"}).first()[0]
    assert 5 * 400 < seen < 0.5 * 400 * 800


def test_small_balls_meet_on_shared_shelves(spark):
    """However small the balls are, a query meets a bank shelf once, and rows are not copied for each pair of balls."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, "g", [float(x) for x in rng.normal(size=4)]) for i in range(400)], "_rn bigint, category string, _v array<double>")
    pairs = neighbours.nearest_pairs(df.where("_rn >= 200"), df.where("_rn < 200"), ["category"], 5, block=4).collect()
    assert len(pairs) == 200 == len({r["_rn"] for r in pairs})


@pytest.mark.parametrize("unit", [True, False])
def test_many_shelves_match_brute_force(spark, monkeypatch, unit):
    monkeypatch.setattr(neighbours, "QUERY_SHELF", 30)
    monkeypatch.setattr(neighbours, "BANK_SHELF", 50)
    rng = np.random.default_rng(4)
    rows = [(f"v{i}", "g", [float(x) for x in rng.normal(size=3) * (1 + i % 3)]) for i in range(120)]
    got = {r["image_id"]: r["distance"] for r in knn_distance(
        vectors(spark, rows), vectors(spark, rows[:60]), ["category"], 4, ["image_id"], "image_id", unit=unit, block=5).collect()}
    want = brute_knn(rows, rows[:60], 4, unit)
    assert got == {i: pytest.approx(v[0], abs=1e-12) for (i, _), v in want.items()}


def test_maps_and_regions_are_passed_on_in_small_runs(spark, monkeypatch):
    frames = [pd.DataFrame({"v": range(10)}), pd.DataFrame({"v": range(3)})]
    runs = list(maps._few(iter(frames), maps.VALUES // 4))
    assert [len(r) for r in runs] == [4, 4, 2, 3] and [v for r in runs for v in r["v"]] == [*range(10), *range(3)]
    monkeypatch.setattr(pixel, "PIXELS", 8)
    mask = [0, 1, 1, 0, 0, 0, 1, 0, 1]
    masks = iter([(pd.Series([np.array(mask)] * 5), pd.Series([3] * 5), pd.Series([3] * 5))])
    labels = list(pixel.region_labels.func(masks))
    assert [len(x) for x in labels] == [1] * 5 and all(list(v) == [0, 1, 1, 0, 0, 0, 2, 0, 3] for x in labels for v in x)


def test_knn_bank_from_the_query_table(spark):
    df = spark.createDataFrame([("a", "c", [1.0, 0.0]), ("b", "c", [0.0, 1.0]),
                                ("z", "other", [1.0, 1.0])],
                               "image_id string, category string, embedding array<double>")
    bank = df.where("image_id = 'a'")
    got = {r["image_id"]: r["distance"] for r in knn_distance(
        df, bank, ["category"], 3, ["image_id"], "image_id").collect()}
    assert got == {"a": pytest.approx(0.0), "b": pytest.approx(1.0), "z": None}


def test_large_groups_cluster_like_small_ones(spark):
    rng = np.random.default_rng(2)
    data = []
    for key, n in (("big", 60), ("small", 6)):
        for i in range(n):
            v = rng.normal(size=3)
            v /= np.linalg.norm(v)
            data.append((key, i, i % 2, [float(x) for x in v]))
    df = spark.createDataFrame(data, "image_id string, sample_idx int, vote int, vector array<double>")
    one = semantic.greedy_clusters(df, 0.8)
    rounds = semantic.greedy_clusters(df, 0.8, limit=10, round_size=4)
    key = ["image_id", "sample_idx"]
    a = {tuple(r[c] for c in key): r["cluster"] for r in one.collect()}
    b = {tuple(r[c] for c in key): r["cluster"] for r in rounds.collect()}
    assert len(set(v for k, v in a.items() if k[0] == "big")) > 4 and a == b


def test_rank_keeps_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 1.0), ("a", None), ("b", 5.0)],
                               "g string, x double")
    out = sorted(((r["g"], r["x"] or -1, r["r"]) for r in
                  signals.pct_rank(df, "x", ["g"], "r").collect()), key=str)
    assert ("a", -1, None) in out and ("b", 5.0, 1.0) in out
    assert [r for g, x, r in out if x == 1.0] == [0.5, 0.5]


def test_template_reference_keeps_shift(spark):
    rng = random.Random(0)
    clean = [("a", 0, [rng.gauss(j * 0.1, 0.01) for j in range(5)]) for _ in range(60)]
    moved = [("a", 0, [rng.gauss(j * 0.1 + 0.05 * (j % 2), 0.05) for j in range(5)])
             for _ in range(60)]
    schema = "category string, label int, tplraw array<double>"
    c, m = spark.createDataFrame(clean, schema), spark.createDataFrame(moved, schema)
    ref = signals.template_reference(c)
    mean = lambda d: d.agg(F.avg("u_prompt_std_z")).first()[0]
    assert mean(signals.prompt_std_z(m, ref)) > 2 * mean(signals.prompt_std_z(c, ref))
    assert mean(signals.prompt_std_z(m)) < 1.5
    with pytest.raises(ValueError):
        signals.template_reference(c.withColumn("label", F.lit(1)))
    with pytest.raises(KeyError):
        signals.get_signal("nope")


def planted(spark, size=32):
    values, mask = np.random.default_rng(1).random((size, size)) * 0.3, np.zeros((size, size), int)
    mask[4:12, 4:12] = 1
    values[4:12, 4:12] += 0.6
    return spark.createDataFrame(
        [("x", "c", "bank", size, size, values.ravel().tolist(), mask.ravel().tolist())],
        "image_id string, category string, map_kind string, h int, w int, values array<double>, mask array<int>")


def test_pixel_metrics_find_a_planted_defect(spark):
    df = planted(spark)
    assert pixel.pixel_auroc(df, ["category"]).first()["pixel_auroc"] > 0.99
    assert pixel.pro_score(df, ["category"]).first()["pro"] > 0.9
    assert pixel.region_sizes(df.select("image_id", "mask", "h", "w")).first()["n_pixels"] == 64


def test_regions_are_four_connected(spark):
    mask = [[1, 1, 0, 0], [0, 0, 1, 0], [1, 0, 1, 1], [1, 0, 0, 0]]
    df = spark.createDataFrame([("x", 4, 4, [v for r in mask for v in r])],
                               "image_id string, h int, w int, mask array<int>")
    sizes = sorted(r["n_pixels"] for r in pixel.region_sizes(df).collect())
    assert sizes == [2, 2, 3]


def test_pro_matches_a_direct_sweep(spark):
    rng = np.random.default_rng(4)
    rows, per_region, normal = [], [], []
    for k in range(3):
        v, m = np.round(rng.random((16, 16)), 2), np.zeros((16, 16), int)
        if k:
            m[2:6, 2:6] = 1
            m[10:12, 10 + k:13 + k] = 1
            v[m == 1] += 0.3
            per_region += [v[2:6, 2:6].ravel(), v[10:12, 10 + k:13 + k].ravel()]
        normal.append(v[m == 0].ravel())
        rows.append((f"i{k}", "c", 16, 16, v.ravel().tolist(), m.ravel().tolist()))
    df = spark.createDataFrame(rows, "image_id string, category string, h int, w int, values array<double>, mask array<int>")
    allv = np.concatenate(normal)
    everything = np.concatenate([allv, *per_region])
    fprs, pros = [], []
    for t in np.linspace(everything.max(), everything.min(), 200):
        fpr = (allv >= t).mean()
        if fpr > 0.3:
            break
        fprs.append(fpr)
        pros.append(np.mean([(r >= t).mean() for r in per_region]))
    if fprs[-1] < 0.3:
        fprs.append(0.3)
        pros.append(pros[-1])
    want = np.trapezoid(pros, fprs) / 0.3
    assert pixel.pro_score(df, ["category"]).first()["pro"] == pytest.approx(want)


def test_painting_averages_overlaps(spark):
    df = spark.createDataFrame([("x", 0, (0, 0, 2, 2), 1.0), ("x", 1, (1, 0, 3, 2), 3.0)],
                               "image_id string, window_idx int, box struct<l:int,t:int,r:int,b:int>, window_score double")
    row = maps.paint(df, 4).first()
    assert row["values"][:4] == [1.0, 2.0, 3.0, 0.0] and sum(row["values"][8:]) == 0.0


def test_hallucination_cases(spark):
    m = planted(spark)
    base = spark.createDataFrame(
        [("x", "c", 1, 1, "upper left"), ("x2", "c", 0, 1, ""), ("x3", "c", 1, 0, ""),
         ("x4", "c", 1, 1, ""), ("x5", "c", 1, 1, "bottom right corner")],
        "image_id string, category string, label int, conformal_pred int, predicted_location string")
    copies = m.unionByName(m.withColumn("image_id", F.lit("x5")))
    out = {r["image_id"]: r["halluc_case"] for r in grounding.hallucination_flags(
        base, copies, copies.select("image_id", "mask")).collect()}
    assert out == {"x": "grounded", "x2": "a_positive_on_good", "x3": "none",
                   "x4": "unverifiable", "x5": "b_wrong_region"}


def test_fusion_refuses_baseline_modes(spark):
    df = spark.createDataFrame([("a", "c", "entropy", 0.2, True)],
                               "image_id string, category string, conformal_mode string, u_conformal double, correct boolean")
    with pytest.raises(ValueError, match="refusing"):
        fusion.trust_scores(df, fusion.FusionConfig())
    allowed = fusion.FusionConfig(allow_baseline_signals=True)
    assert fusion.trust_scores(df, allowed).count() == 1


def test_hallucination_annihilates_the_product(spark):
    df = spark.createDataFrame([(f"r{i}", "c", i / 10, i / 10, i == 3) for i in range(6)],
                               "image_id string, category string, u_conformal double, cmcs double, halluc boolean")
    out = {r["image_id"]: r for r in fusion.trust_scores(df, fusion.FusionConfig()).collect()}
    assert out["r3"]["trust_proposal_product"] == 0.0
    assert out["r3"]["trust_weighted_geometric"] > 0.0


def test_silent_failure_counts_undefined_correlation(spark):
    rows = [("none", 0, 0.9, 0.5, 0.1)] + [("blur", s, 0.9 - 0.05 * s, 0.5, 0.1 + s)
                                           for s in range(1, 6)]
    sweep = spark.createDataFrame(rows, "corruption string, severity int, auroc double, mean_u_flat double, mean_u_up double")
    out = {r["signal"]: r for r in shift.monotonicity(sweep, ["u_flat", "u_up"]).collect()}
    assert out["u_flat"]["rho_undefined"] and out["u_flat"]["silent_failure"]
    assert not out["u_up"]["silent_failure"]


def test_records_round_trip_and_rules(spark, tmp_path):
    run = {"run_id": "r", "scorer_name": "s", "model_id": "m", "subset_tag": "full",
           "corruption": "none", "severity": 0}
    df = records.finalize(spark.createDataFrame(
        [("a", "c", 0, "test", 0.2), ("b", "c", 1, "test", 0.9)],
        "image_id string, category string, label int, split string, anomaly_score double"), run)
    path = records.write_records(df, f"{tmp_path}/r")
    assert records.read_records(spark, path).count() == 2
    with pytest.raises(ValueError, match="duplicate"):
        records.validate(df.unionByName(df))
    with pytest.raises(ValueError, match="score outside"):
        records.validate(df.withColumn("anomaly_score", F.lit(1.5)))
    records.validate(df.withColumns({"anomaly_score": F.lit(float("nan")),
                                     "parse_ok": F.lit(False)}))
    with pytest.raises(ValueError, match="missing column"):
        records.validate(df.drop("split"))
    with pytest.raises(Exception):
        records.read_records(spark, f"{tmp_path}/absent")


def test_subsets(spark):
    paths = spark.createDataFrame([(f"/d/cat/{s}/{f}/{i}.png",) for s, f in (
        ("train", "good"), ("test", "good"), ("test", "scratch")) for i in range(9)], "path string")
    got = index.build_index(paths, test_per_folder=5).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 9, "test": 10}
    with pytest.raises(FileNotFoundError):
        index.build_index(paths, categories=["absent"])


def test_embedding_store_tops_up(spark, tmp_path):
    store = stores.EmbeddingStore(spark, f"{tmp_path}/emb")
    idx = spark.createDataFrame([(f"i{k}", [0.5, float(k)]) for k in range(5)],
                                "image_id string, embedding array<float>")
    keys = {"model_tag": "m", "category": "a", "split": "test", "kind": "image"}
    assert store.missing(idx, **keys).count() == 5
    with pytest.raises(FileNotFoundError):
        store.load(**keys)
    store.save(idx.limit(2), **keys)
    assert not store.covers(idx, **keys) and store.missing(idx, **keys).count() == 3
    store.top_up(idx, **keys)
    assert store.covers(idx, **keys) and store.load(**keys).count() == 5
    store.save(idx, **keys)
    store.save(idx.limit(3), model_tag="m", category="b", split="test", kind="image")
    assert store.load(**keys).count() == 5 and store.load(model_tag="m").count() == 8


def test_outcomes(spark):
    df = spark.createDataFrame([(1, 1), (0, 0), (1, 0), (0, 1)], "label int, conformal_pred int")
    assert [r["prediction_type"] for r in browse.prediction_type(df).collect()] == [
        "TP", "TN", "FN", "FP"]
    with pytest.raises(KeyError):
        browse.prediction_type(df.drop("conformal_pred"))


def test_halves_are_stratified(spark):
    df = spark.createDataFrame([(f"r{i}", f"c{i % 2}", i % 3 == 0) for i in range(60)],
                               "image_id string, category string, label boolean")
    out = report.assign_halves(df).groupBy("category", "label", "bakeoff_half").count().collect()
    assert sorted(r["count"] for r in out) == [5, 5, 5, 5, 10, 10, 10, 10]


def test_report_interval_brackets_the_point(spark):
    rng = random.Random(2)
    data = [(f"r{i}", f"c{i % 2}", int(i % 3 == 0), min(1.0, rng.random() * .7 + .3 * (i % 3 == 0)),
             True, i % 4 != 0, rng.random()) for i in range(200)]
    df = spark.createDataFrame(data, "image_id string, category string, label int, anomaly_score double, parse_ok boolean, correct boolean, u_x double")
    tables = report.build_report(df, n_boot=50)
    assert set(tables) == {"detection", "calibration", "abstention", "estimators",
                           "error_prediction", "selective"}
    for r in tables["detection"].collect():
        if r["group"] != "MEAN_OF_CATEGORIES":
            assert r["auroc_ci_lo"] <= r["auroc"] <= r["auroc_ci_hi"]
            assert r["aupr_ci_lo"] <= r["aupr_ci_hi"]




def test_regions_of_winding_shapes():
    def plain(inside):
        label = np.zeros(inside.shape, int)
        n = 0
        for r, c in zip(*np.nonzero(inside)):
            if label[r, c]:
                continue
            n += 1
            stack = [(r, c)]
            while stack:
                i, j = stack.pop()
                if 0 <= i < inside.shape[0] and 0 <= j < inside.shape[1] and inside[i, j] and not label[i, j]:
                    label[i, j] = n
                    stack += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
        return label

    rng = np.random.default_rng(5)
    spiral = np.zeros((21, 21), bool)
    spiral[::2] = True
    spiral[1::4, -1] = spiral[3::4, 0] = True
    for image in [spiral, spiral.T, np.ones((3, 4), bool), np.zeros((2, 2), bool),
                  *[rng.random((rng.integers(1, 12), rng.integers(1, 12))) < p for p in (0.3, 0.5, 0.6, 0.8) for _ in range(15)]]:
        assert (pixel._region_numbers(image) == plain(image)).all()


def test_masks_of_another_size(spark):
    small = np.zeros((4, 4), int)
    small[1:3, 1:3] = 1
    large = np.kron(small, np.ones((2, 2), int))
    maps_ = spark.createDataFrame([("a", "c", 4, 4, [float(x) for x in small.ravel()]), ("b", "c", 4, 4, [0.0] * 16)],
                                  "image_id string, category string, h int, w int, values array<double>")
    masks = spark.createDataFrame([("a", 8, 8, large.ravel().tolist())], "image_id string, h int, w int, mask array<tinyint>")
    rows = {r["image_id"]: r for r in pixel.with_masks(maps_, masks).collect()}
    assert rows["a"]["mask"] == small.ravel().tolist() == rows["a"]["labels"] and not any(rows["b"]["labels"])
    records = spark.createDataFrame([("a", 1, 1)], "image_id string, label int, conformal_pred int")
    out = grounding.hallucination_flags(records, maps_, masks, top_frac=0.25, use_claim=False).first()
    assert out["gt_iou"] == pytest.approx(1.0) and out["halluc_case"] == "grounded"
    broken = masks.withColumn("h", F.lit(7))
    with pytest.raises(Exception, match="size it claims"):
        pixel.with_masks(maps_, broken).collect()


def test_template_without_reference_keeps_the_others(spark):
    ref = spark.createDataFrame([("g", [1.0, None, 3.0]), ("g", [3.0, None, 7.0])], "category string, tplraw array<double>")
    df = spark.createDataFrame([("g", [2.0, 9.0, 9.0])], "category string, tplraw array<double>")
    out = signals.prompt_std_z(df, signals.template_reference(ref, check=False)).first()
    # Templates 0 and 2: z = 0 and 2, spread 1; template 1 has no reference and is left out.
    assert out["u_prompt_std_z"] == pytest.approx(1.0)


def test_unpaired_templates_raise(spark):
    text = spark.createDataFrame([("g", "normal", 0, [1.0, 0.0]), ("g", "normal", 1, [0.0, 1.0]), ("g", "anomaly", 0, [0.5, 0.5])],
                                 "category string, polarity string, template_idx int, embedding array<double>")
    df = spark.createDataFrame([("a", "g", [1.0, 0.0])], "image_id string, category string, embedding array<double>")
    with pytest.raises(Exception, match="without a partner"):
        scoring.template_scores(df, text, 0.1).collect()


def test_clusters_do_not_depend_on_the_path(spark):
    rng = np.random.default_rng(6)
    rows = [(f"i{k}", j, 1, (v / np.linalg.norm(v)).tolist()) for k in range(3) for j, v in enumerate(rng.random((40, 4)))]
    df = spark.createDataFrame(rows, "image_id string, sample_idx int, vote int, vector array<double>")
    one = sorted(map(tuple, semantic.greedy_clusters(df, 0.9).collect()))
    rounds = sorted(map(tuple, semantic.greedy_clusters(df, 0.9, limit=5, round_size=4).collect()))
    assert one == rounds and len({r[3] for r in one}) > 3


def test_rows_without_embedding_raise_when_scored(spark):
    text = spark.createDataFrame([("g", "normal", 0, [1.0, 0.0]), ("g", "anomaly", 0, [0.0, 1.0])],
                                 "category string, polarity string, template_idx int, embedding array<double>")
    index_ = spark.createDataFrame([("a", "g"), ("b", "g")], "image_id string, category string")
    emb = spark.createDataFrame([("a", [1.0, 0.0])], "image_id string, embedding array<double>")
    assert scoring.score_index(index_.where("image_id = 'a'"), emb, text, 0.1).count() == 1
    with pytest.raises(Exception, match="no stored embedding"):
        scoring.score_index(index_, emb, text, 0.1).collect()
    with pytest.raises(ValueError, match="no text"):
        scoring.score_index(index_.withColumn("category", F.lit("x")), emb, text, 0.1)


def greedy_entailment(n, scores, threshold):
    """Clusters of samples 0 .. n - 1 in plain Python."""
    number, out = {}, []
    for i in range(n):
        fit = [(-min(scores.get((j, i), 0.0), scores.get((i, j), 0.0)), j) for j in number]
        best = min(fit, default=(0.0, None))
        if -best[0] >= threshold:
            out.append(number[best[1]])
        else:
            number[i] = len(number)
            out.append(number[i])
    return out


@pytest.mark.parametrize("prefix", [3, 512])
def test_entailment_in_rounds_matches_the_greedy_order(spark, prefix):
    rng = random.Random(4)
    samples, pairs, want = [], [], {}
    for key, n in (("a", 60), ("b", 1), ("c", 25), ("none", 4)):
        scores = {(i, j): rng.choice([0.2, 0.5, 0.7, 0.9]) for i in range(n) for j in range(n) if rng.random() < (0.0 if key == "none" else 0.5)}
        samples += [(key, i, i % 2) for i in range(n)]
        pairs += [(key, i, j, e) for (i, j), e in scores.items()] + [(key, 0, n + 5, 1.0), (key, n + 5, 0, 1.0)]
        want |= {(key, i): c for i, c in enumerate(greedy_entailment(n, scores, 0.5))}
    rows = spark.createDataFrame(samples, "image_id string, sample_idx int, vote int")
    table = spark.createDataFrame(pairs, "image_id string, premise int, hypothesis int, entail double")
    got = {(r["image_id"], r["sample_idx"]): r["cluster"] for r in semantic.entailment_clusters(rows, table, prefix=prefix).collect()}
    assert got == want


def test_entailment_of_a_large_group(spark):
    """20,000 samples of one key whose links form long chains and stars."""
    n = 20_000
    samples = spark.range(n).selectExpr("'k' as image_id", "cast(id as int) as sample_idx", "1 as vote")
    # Multiples of 100 are stars, the samples between them a chain.
    links = [(i, i - 1) for i in range(1, n) if i % 100 > 1] + [(i - i % 100, i) for i in range(n) if i % 100 and i % 7 == 0]
    pairs = spark.createDataFrame([("k", a, b, 0.8) for a, b in links] + [("k", b, a, 0.9) for a, b in links],
                                  "image_id string, premise int, hypothesis int, entail double")
    got = [r["cluster"] for r in semantic.entailment_clusters(samples, pairs).orderBy("sample_idx").collect()]
    near = {}
    for a, b in links:
        near.setdefault(max(a, b), []).append(min(a, b))
    number, want = {}, []
    for i in range(n):
        led = sorted(j for j in near.get(i, []) if j in number)
        number.setdefault(i, len(number)) if not led else None
        want.append(number[led[0] if led else i])
    assert got == want


def test_logistic_trust_is_at_its_optimum(spark):
    rng = np.random.default_rng(6)
    rows = [(f"r{i}", "g", float(rng.random()), float(rng.random()), bool(rng.random() < 0.3), int(rng.random() < 0.4)) for i in range(200)]
    df = spark.createDataFrame(rows, "image_id string, category string, u_conformal double, cmcs double, halluc boolean, label int")
    config = fusion.FusionConfig()
    one = fusion.fit_logistic(df, config, "label", c=0.7)
    again = fusion.fit_logistic(df.repartition(7), config, "label", c=0.7)
    assert one.names == again.names and np.allclose([*one.weights, one.intercept], [*again.weights, again.intercept], atol=1e-9)
    table = fusion.factors(df, config)[0].select("label", *[fusion.factor(n) for n in one.names]).toPandas()
    x, y, w = table.iloc[:, 1:].to_numpy(float), table["label"].to_numpy(), np.array(one.weights)
    p = 1 / (1 + np.exp(-(x @ w + one.intercept)))
    assert np.abs(0.7 * (p - y) @ x + w).max() < 1e-7 and abs((p - y).sum()) < 1e-7


def test_copartitioned_tables_join_without_a_shuffle(spark, tmp_path):
    store = stores.CoPartitioned(spark, str(tmp_path), buckets=4)
    records = spark.createDataFrame([(f"r{i}", i) for i in range(50)] + [(None, -1)], "image_id string, n int")
    scores = spark.createDataFrame([(f"r{i % 40}", f"m{i % 3}", float(i)) for i in range(120)], "image_id string, model_tag string, anomaly_score double")
    store.save("records", records)
    store.save("scores", scores)
    again = stores.CoPartitioned(spark, str(tmp_path), buckets=4)
    spark.sql(f"DROP TABLE {again._place('scores')[1]}")       # another session knows only the path
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = signals.model_scores(again.load("records"), again.load("scores"), ["n"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        got = sorted(map(str, joined.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted(map(str, signals.model_scores(records, scores, ["n"]).collect())) and len(got) == 131
    store.save("records", records.limit(5))
    assert store.load("records").count() == 5


def test_bakeoff_of_records_picks_the_planted_signal(spark):
    rng = np.random.default_rng(11)
    rows = [(f"r{i}", "ab"[i % 2], "train", 0, float(rng.normal()), 0.0, True) for i in range(200)]
    for i in range(400):
        label = int(rng.integers(0, 2))
        rows.append((f"t{i}", "ab"[i % 2], "test", label, float(rng.normal() + label), float(label + rng.normal() / 4), True))
    records = spark.createDataFrame(rows, "image_id string, category string, split string, label int, anomaly_score double, u_planted double, parse_ok boolean")
    out = report.bakeoff_of_records(records, ["abstention"], ["log"], n_boot=100)
    best = out.winner.first()
    assert best["selected_signal"] == "u_planted" and best["select_auroc"] > 0.95
    assert best["report_ci_lo"] <= best["report_auroc"] <= best["report_ci_hi"]
    assert {r["signal"] for r in out.table.select("signal").distinct().collect()} == {
        "u_conformal", "u_conformal_log", "u_planted", "u_abstention", "BASELINE:score", "BASELINE:1-score"}
    assert out.records.count() == 400


def test_large_groups_get_larger_shelves(spark, monkeypatch):
    """Past a number of shelves they grow, so fewer copies are sent; distances stay those of brute force."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(900, 4))
    rows = spark.createDataFrame([("g", i, x.tolist()) for i, x in enumerate(v)], "g string, i bigint, embedding array<double>")
    for name, value in {"QUERY_SHELF": 64, "BANK_SHELF": 64, "QUERY_SHELVES": 4, "BANK_SHELVES": 4}.items():
        monkeypatch.setattr(neighbours, name, value)
    balls = rows.select("g", F.col("i").alias("_rn"), F.col("embedding").alias("_v"), (F.col("i") % 100).alias("_ball"))
    assert neighbours._shelves(balls, ["g"], True, 64).count() > 40
    assert neighbours._shelves(balls, ["g"], True, 64, 4, 100).count() <= 5
    assert 8 <= neighbours._shelves(balls, ["g"], True, 64, 4, 4).count() <= 16
    found = neighbours.knn_distance(rows, rows.where("i % 3 = 0"), ["g"], 3, ["i"], "i", block=50).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    best = np.sort(unit @ unit[::3].T, axis=1)[:, -3:].mean(axis=1)
    assert len(found) == 900 and all(r.distance == pytest.approx(1 - best[r.i], abs=1e-9) for r in found)
