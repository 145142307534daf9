"""Times the headline queries once each, after a warm-up, and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pointloom.plans import catalog
from pointloom.session import local_session

HEADLINE = [
    "flt1_plane_ground", "flt2_percentile_prefilter", "flt7_mad_filter", "smp6_voxel_downsample", "til1_sliding_tiles", "jn5_radius_join", "jn6_ball_query",
    "jn11_proposal_overlaps", "ag6_covariance", "ag10_confusion", "me1_instance_matching", "me2_detection_metrics", "me7_panoptic_quality", "cl2_dbscan",
    "rf7_tiny_fragments", "rf10_noise_to_nearest", "gd3_terrain_grid", "tt2_heights", "st11_signed_rank", "ag14_scene_gain_counts",
    "cl11_watershed", "rf1_skeleton_split", "rf12_post_stage_chain",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "12g")
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bench-"))
    catalog.QUERIES["ag1_label_statistics"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(os.path.basename(folder.rstrip("/")).removeprefix("sf") or 0)}))
    spark.stop()


if __name__ == "__main__":
    main()
