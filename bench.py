"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from stellate.plans.queries import QUERIES
from stellate.session import get_spark

HEADLINE = ["knn_l2", "knn_cosine", "knn_ip", "knn_l1", "knn_batch", "ivf_index", "vec_normalize", "scan_all", "arr_insert", "map_upsert", "hash_murmur32", "mvcc_current", "checkpoint_roundtrip"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    base = tempfile.mkdtemp(prefix="bench-")
    spark = get_spark("bench", f"local[{cpus}]", {"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": cpus, "spark.checkpoint.dir": f"file://{base}"})
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):  # the first one warms up
            t = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        took[name] = round(statistics.median(runs[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
