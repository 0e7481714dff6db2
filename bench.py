"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from labelloom.plans.queries import QUERIES

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["G2_auroc", "G5_threshold_sweep", "G6_threshold_for_recall", "I7_feature_drift", "H3_segment_report", "E8_relative_size", "A18_yolo", "D4_split_by_group", "E4_feedback", "E1_resolve", "H14_still_frames", "K8_sliding_windows", "K10_anomaly_fit", "K11_anomaly_scores", "K14_blob_boxes"]


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF}/lineitem.parquet").count()  # the session's own start is not a query's time
    runs = []
    for _ in range(2):  # the first run compiles a query's code, the second finds it
        runs.append({})
        for name in HEADLINE:
            began = time.perf_counter()
            QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            runs[-1][name] = round(time.perf_counter() - began, 3)
    took, again = runs
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "again": again, "sf": os.path.basename(SF).removeprefix("sf")}))


if __name__ == "__main__":
    main()
