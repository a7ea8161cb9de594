"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import sys
import time

from mesograph.queries import all_queries
from mesograph.session import build_session

HEADLINE = [
    "describe_metric", "measurement_stats", "min_area_rect_aspect", "label_counts",
    "local_density_annotations", "nearest_neighbour_annotations", "dbscan", "ripley_l", "group_summary_ci", "kruskal_wallis",
    "mann_whitney", "bh_fdr", "dose_series", "laplacian_variance", "normalize_percentile", "low_freq_fraction", "rasterize_roi",
    "mask_iou", "measure_annotations", "extract_points", "rle_encode", "connected_components", "contour_metrics", "richardson", "sa_fourier", "candidate_links",
    "link_frames", "track_annotations", "compound_auto", "kde_grid", "permutation_test", "estimate_surface_area", "boxes_to_tiles", "split_sources", "dataset_stats", "class_by_split", "yolo_dataset",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        seconds[name] = round(statistics.median(runs), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


main()
