"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the input
and the cores. Every query is planned and run to its last row, into Spark's noop sink.
"""

import json
import os
import time

from thresher.plans.catalogue import QUERIES
from thresher.session import build_session

HEADLINE = (
    "hardest_overall", "hardest_by_category", "hard_plus_random", "round_robin_line_items", "quota_with_topup",
    "capped_arrivals", "first_per_digest", "group_representative", "report_exemplars",
    "stratified_group_split", "hash_split_by_content", "thinned_sources", "seeded_sample", "oversampled", "pair_plan",
    "confusion_by_split_and_category", "classification_report", "roc_area_by_split", "precision_recall_curve",
    "multiclass_report", "negative_score_summary", "summary_with_totals", "row_weights", "folder_regression",
    "leaking_groups", "table_fingerprint", "paired_changes",
    "recall_threshold_by_misses", "recall_target_sweep", "fusion_calibration", "route_grid", "speed_profiles",
    "best_candidate", "select_on_val_report_on_test",
    "derive_classes", "inherit_from_root", "repair_by_lineage", "exclude_known_content", "resume_arrivals", "add_mined_train",
    "eligible_text", "annotation_text", "content_digest", "batch_scores", "stream_exact_dedup", "stream_with_quotas",
    "build_training_table", "mine_into_training_manifest", "calibrate_and_compare",
)


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("thresher-bench", master=f"local[{cores}]", **{
        "spark.sql.shuffle.partitions": cores, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy().count().collect()  # start the executor threads
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))


if __name__ == "__main__":
    main()
