"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "stratified_folds", "inner_holdout", "nested_subsets", "training_mean_reference", "oof_predictions", "fold_and_pooled_metrics",
    "stratified_metrics", "residual_correlations", "notable_cases", "learning_summary", "paired_bootstrap", "feature_evidence",
    "text_feature_correlations", "mask_features", "mask_features_scaled", "feature_redundancy", "component_counts", "mask_quality",
    "mask_expansion", "mask_contraction", "mask_scale_grow", "morphology_eligibility", "sensitivity_summary", "mask_letterbox",
    "mask_integrity", "nearest_neighbours", "table_fingerprint", "number_text",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from maskwright.plans import QUERIES

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    with contextlib.suppress(Exception):
        run("category_profile")  # starts the JVM's compiler and the Python workers
    times = {name: round(run(name), 3) for name in wanted}
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
