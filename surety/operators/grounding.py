"""Does a stated location agree with the score map, and with the true defect?

Maps and masks are one array per image, and every expression here is local to the row: no
pixel is exploded and nothing is shuffled but the joins on ``image_id``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.functions.columns import array_quantile, clip, let, on_grid, or_null, ratio
from surety.functions.text import location_claim
from surety.operators.pixel import sized
from surety.operators.signals import pct_ranks
from surety.plans.joins import attach_groups, require_none
from surety.plans.ranking import quantiles, ranked_cells, with_pooled
from surety.session import materialise

#: IoU thresholds of the sensitivity table (fixed values).
IOU_THRESHOLDS = (0.0, 0.01, 0.05, 0.1, 0.2, 0.3)
ARMS = ("language_grounding", "global_spatial")


def claim_mask(claim: Column, values: Column, size: Column, edge_width: float = 0.18) -> Column:
    """Boolean array of the pixels a claim covers, on the grid of ``values``."""
    limits = F.struct(
        claim["kind"].alias("kind"), size.alias("size"),
        F.greatest(F.bround(size * F.lit(edge_width)), F.lit(1.0)).cast("int").alias("edge"),
        (claim["r0"] * size).cast("int").alias("r0"), F.ceil(claim["r1"] * size).alias("r1"),
        (claim["c0"] * size).cast("int").alias("c0"), F.ceil(claim["c1"] * size).alias("c1"))

    def covered(k: Column, i: Column) -> Column:
        r, c = F.floor(i / k["size"]), i % k["size"]
        last = k["size"] - k["edge"]
        frame = (r < k["edge"]) | (r >= last) | (c < k["edge"]) | (c >= last)
        band = (r >= k["r0"]) & (r < k["r1"]) & (c >= k["c0"]) & (c < k["c1"])
        return (F.when(k["kind"] == "none", F.lit(False))
                .when(k["kind"] == "edge", frame).otherwise(band))

    return let(limits, lambda k: F.transform(values, lambda _v, i: covered(k, i)))


def attended_region(values: Column, top_frac: float = 0.05) -> Column:
    """Boolean array of the top-scoring share of the map; ties at the cut are kept."""
    k = F.greatest(F.bround(F.size(values) * F.lit(top_frac)), F.lit(1.0)).cast("int")
    cut = F.element_at(F.sort_array(values, asc=False), k)
    return let(cut, lambda c: F.transform(values, lambda v: v >= c))


def count_true(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: x))


def region_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boolean arrays; 0 when both are empty."""
    both = count_true(F.zip_with(a, b, lambda x, y: x & y))
    either = count_true(F.zip_with(a, b, lambda x, y: x | y))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean of the values where the mask is set; NULL where it is empty."""
    total = F.aggregate(F.zip_with(values, mask, lambda v, m: F.when(m, v.cast("double"))
                                   .otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    n = count_true(mask)
    return F.when(n > 0, total / n)


def spatial_evidence(values: Column, q: float = 0.99) -> Column:
    return array_quantile(values, q)


def claim_grounding(df: DataFrame, location: str = "predicted_location",
                    top_frac: float = 0.05, edge_width: float = 0.18) -> DataFrame:
    """Overlap and contrast of the claimed region with the map in the same row.

    A claim that narrows nothing covers the whole image. A row without a map is
    ``missing_map``.
    """
    has_map = F.col("values").isNotNull()
    df = df.withColumn("_claim", location_claim(F.col(location)))
    claim = F.col("_claim")
    mask = F.when(claim["is_localized"],
                  claim_mask(claim, F.col("values"), F.col("h"), edge_width)).otherwise(
        F.transform("values", lambda v: F.lit(True)))
    df = df.withColumns({"_mask": mask, "_seen": attended_region(F.col("values"), top_frac)})
    outside = F.transform("_mask", lambda m: ~m)
    df = df.withColumns({
        "claim_kind": F.when(has_map, claim["kind"]).otherwise(F.lit("missing_map")),
        "claim_localized": has_map & claim["is_localized"],
        "claim_iou": F.when(has_map, region_iou(F.col("_mask"), F.col("_seen"))),
        "claim_inside_mean": masked_mean(F.col("values"), F.col("_mask")),
        "claim_outside_mean": masked_mean(F.col("values"), outside)})
    contrast = F.when(F.col("claim_outside_mean") > 0,
                      F.col("claim_inside_mean") / F.col("claim_outside_mean"))
    return df.withColumn("claim_contrast", contrast).drop("_claim", "_mask", "_seen")


def with_evidence(records: DataFrame, maps: DataFrame | None = None, masks: DataFrame | None = None,
                  row: str = "image_id", columns: Sequence[str] = ()) -> DataFrame:
    """Attach ``columns`` of the maps and say what a row can be held against.

    ``map_status`` is ``map`` or ``missing_map``, ``mask_status`` is ``mask`` or ``unverifiable``; rows
    without a map or mask stay.
    """
    out = records
    for table, name, there, lost, kept in ((maps, "map_status", "map", "missing_map", columns), (masks, "mask_status", "mask", "unverifiable", ())):
        if table is not None:
            out = out.join(table.select(row, *kept, F.lit(there).alias(name)), row, "left").withColumn(name, F.coalesce(name, F.lit(lost)))
    return out


def cmcs(records: DataFrame, maps: DataFrame, arm: str = "language_grounding",
         group: str = "category", row: str = "image_id", quantile: float = 0.99,
         top_frac: float = 0.05, edge_width: float = 0.18) -> DataFrame:
    """Cross-modal consistency of the score with the map, and with the stated location."""
    if arm not in ARMS:
        raise KeyError(f"unknown arm {arm!r}; one of {ARMS}")
    out = with_evidence(records, maps, row=row, columns=["h", "values"]).drop("map_status")
    out = out.withColumn("spatial_score", spatial_evidence(F.col("values"), quantile))
    if arm == "language_grounding":
        out = claim_grounding(out, top_frac=top_frac, edge_width=edge_width)
    # The maps are not needed any more: keep their summaries rather than read them again.
    out = materialise(out.drop("values", "h"))
    names = {"anomaly_score": "s_sem_rank", "spatial_score": "s_spatial_rank"}
    if arm == "language_grounding":
        names["claim_contrast"] = "_contrast"
    out = pct_ranks(out, names, [group])
    agreement = F.lit(1.0) - F.abs(F.col("s_sem_rank") - F.col("s_spatial_rank"))
    if arm == "global_spatial":
        return out.withColumns({"cmcs": agreement, "cmcs_arm": F.lit(arm)})
    half = F.lit(0.5)
    return out.withColumns({
        "cmcs": half * F.coalesce("_contrast", half) + half * agreement,
        "cmcs_arm": F.lit(arm)}).drop("_contrast")


def cmcs_literal(records: DataFrame, maps: DataFrame, row: str = "image_id",
                 quantile: float = 0.99) -> DataFrame:
    """Consistency on the raw scales: ``1 - |score - spatial|``."""
    out = records.join(maps.select(row, "values"), row, "left")
    spatial = spatial_evidence(F.col("values"), quantile)
    return out.withColumn("cmcs_literal",
                          F.lit(1.0) - F.abs(F.col("anomaly_score") - spatial)).drop("values")


def cmcs_summary(records: DataFrame, group: str = "category") -> DataFrame:
    """Mean consistency overall, on normals and on anomalies."""
    label = F.col("label")
    return records.groupBy(group).agg(
        F.avg("cmcs").alias("mean_cmcs"),
        F.avg(F.when(label == 0, F.col("cmcs"))).alias("mean_cmcs_normal"),
        F.avg(F.when(label == 1, F.col("cmcs"))).alias("mean_cmcs_anomalous"))


def flag_thresholds(cal: DataFrame, group: str = "category", cmcs_quantile: float = 0.10,
                    score_quantile: float = 0.90, theta_cmcs: float = 0.5,
                    theta_score: float = 0.5) -> DataFrame:
    """Per-group thresholds of the flag from normal rows, with defaults for empty pools."""
    if "label" in cal.columns:
        require_none(cal.where(F.col("label") != 0).select(group, "label"),
                     "flag thresholds must be fitted on normal-only rows")
    n = {"n": F.lit(1)}
    low = quantiles(ranked_cells(cal, [group], "cmcs", n), [group], "cmcs",
                    {"theta_cmcs": cmcs_quantile}).drop("n_total")
    high = quantiles(ranked_cells(cal, [group], "anomaly_score", n), [group], "anomaly_score",
                     {"theta_anom": score_quantile}).drop("n_total")
    groups = cal.select(group).distinct()
    return groups.join(low, group, "left").join(high, group, "left").select(
        group, F.coalesce("theta_cmcs", F.lit(theta_cmcs)).alias("theta_cmcs"),
        F.coalesce("theta_anom", F.lit(theta_score)).alias("theta_anom"))


def attenuate(records: DataFrame, thresholds: DataFrame | None = None, alpha: float = 1.5,
              theta_cmcs: float = 0.5, theta_score: float = 0.5,
              group: str = "category") -> DataFrame:
    """Flag confident scores with low consistency and lower them by ``cmcs ** alpha``."""
    if thresholds is None:
        out = records.withColumns({"theta_cmcs": F.lit(theta_cmcs),
                                   "theta_anom": F.lit(theta_score)})
    else:
        out = attach_groups(records, thresholds, [group]).withColumns({
            "theta_cmcs": F.coalesce("theta_cmcs", F.lit(theta_cmcs)),
            "theta_anom": F.coalesce("theta_anom", F.lit(theta_score))})
    s, c = or_null(F.col("anomaly_score")), clip(or_null(F.col("cmcs")), 0.0, 1.0)
    flag = F.coalesce((c < F.col("theta_cmcs")) & (s > F.col("theta_anom")), F.lit(False))
    lowered = s * F.pow(F.greatest(c, F.lit(1e-9)), F.lit(alpha))
    return out.withColumns({"halluc_flag_eq4": flag,
                            "s_adj": F.when(flag, lowered).otherwise(F.col("anomaly_score"))})


def hallucination_flags(records: DataFrame, maps: DataFrame, masks: DataFrame,
                        iou_threshold: float = 0.05, top_frac: float = 0.05,
                        edge_width: float = 0.18, use_claim: bool = True,
                        prediction: str = "conformal_pred", row: str = "image_id",
                        location: str = "predicted_location") -> DataFrame:
    """Unfounded positive predictions, by case.

    A positive on a normal image is case (a). On an anomalous one the claimed region (or the
    attended region when the claim narrows nothing) must overlap the true mask; below the IoU
    threshold it is case (b). Without a mask or map it cannot be verified.
    """
    out = (records.join(maps.select(row, "h", "w", "values"), row, "left")
           .join(sized(masks, row), row, "left"))
    # A mask of another size is brought to the map's grid (nearest pixel).
    out = out.withColumn("_mask", on_grid(F.col("_mask"), F.col("_mh"), F.col("_mw"), F.col("h"),
                                          F.col("w")))
    if location not in out.columns:
        out = out.withColumn(location, F.lit(""))
    out = out.withColumn("_claim", location_claim(F.col(location)))
    claim = F.col("_claim")
    seen = attended_region(F.col("values"), top_frac)
    region = seen if not use_claim else F.when(
        claim["is_localized"],
        claim_mask(claim, F.col("values"), F.col("h"), edge_width)).otherwise(seen)
    truth = F.transform("_mask", lambda m: m > 0)
    positive = F.coalesce(F.col(prediction), F.lit(0)) == 1
    normal = F.col("label") == 0
    verifiable = F.col("_mask").isNotNull() & F.col("values").isNotNull()
    iou = (F.when(~positive, F.lit(None)).when(normal, F.lit(0.0))
           .when(verifiable, region_iou(region, truth)))
    out = out.withColumn("gt_iou", iou.cast("double")).drop("values", "h", "w", "_mh", "_mw", "_mask", "_claim")
    return flag_cases(out.withColumn("_positive", positive), iou_threshold).drop("_positive")


def flag_cases(df: DataFrame, threshold: float | Column) -> DataFrame:
    """``halluc_case`` and ``halluc`` from the stored overlap."""
    case = (F.when(~F.col("_positive"), "none").when(F.col("label") == 0, "a_positive_on_good")
            .when(F.col("gt_iou").isNull(), "unverifiable")
            .when(F.col("gt_iou") < threshold, "b_wrong_region").otherwise("grounded"))
    return df.withColumn("halluc_case", case).withColumn(
        "halluc", F.col("halluc_case").isin("a_positive_on_good", "b_wrong_region"))


def _rates(keys: Sequence[str], df: DataFrame) -> DataFrame:
    case = F.col("halluc_case")
    n_pos = F.count(F.when(case != "none", 1))

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), n_pos.alias("n_positive"),
        ratio(count(F.col("halluc") & (case != "none")), n_pos).alias("hr"),
        ratio(count(case == "a_positive_on_good"), n_pos).alias("hr_case_a"),
        ratio(count(case == "b_wrong_region"), n_pos).alias("hr_case_b"),
        count(case == "unverifiable").alias("n_unverifiable"))


def hallucination_rate(flagged: DataFrame, group: str = "category") -> DataFrame:
    """Rates over positive predictions, per group and pooled."""
    return _rates(["group"], with_pooled(flagged.select(group, "halluc", "halluc_case"), group))


def iou_sensitivity(flagged: DataFrame,
                    thresholds: Sequence[float] = IOU_THRESHOLDS) -> DataFrame:
    """Pooled rates at several IoU thresholds, from the overlap computed once."""
    base = flagged.select("label", "gt_iou", (F.col("halluc_case") != "none").alias("_positive"))
    grid = base.withColumn("iou_threshold", F.explode(F.array(*[
        F.lit(float(t)) for t in thresholds])))
    return _rates(["iou_threshold"], flag_cases(grid, F.col("iou_threshold"))).select(
        "iou_threshold", "hr", "hr_case_a", "hr_case_b", "n_positive")
