"""Headline queries, timed. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from catalog import load
from surety.session import local_session

HEADLINE = [
    "c2_conformal_pvalue", "c6_calibrate_stage_line", "c10_delta_sweep", "c12_prediction_sets",
    "m1_auroc_line", "m10_calibration_table", "m12_error_prediction", "w5_selective_table",
    "b4_delong", "b1_bootstrap_auroc", "k1_knn_distance", "u3_backbone_ensemble",
    "p10_parse_generation", "p5_template_scores", "m19_pixel_auroc", "m20_pro",
    "h7_hallucination_flags", "f6_leave_one_out", "d1_shift_cells", "s1_build_index",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "*"), "bench")
    queries, _ = load()
    spark.range(1000).selectExpr("sum(id)").collect()    # start the executors
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        # The noop sink computes every row and column without collecting anything.
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
