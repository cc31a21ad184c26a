"""Headline queries, timed end to end.  Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.  Every query is run to the
last row into a sink that drops them.
"""

from __future__ import annotations

import json
import os
import sys
import time

from plumbline.plans.catalog import REGISTRY
from plumbline.session import local_session, release

QUERIES = [
    "preprocess", "lf_summary", "weak_labels", "map_3class", "symbolic_features", "embed_text", "tfidf_stats",
    "oob_probs", "label_issues", "augment_stories", "similar_topk", "roc_auc", "health_report", "scope_impact",
    "explanations", "train_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4)), "plumbline-bench")
    spark.sparkContext.setLogLevel("OFF")
    REGISTRY["story_count"](spark, sf_dir).collect()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or QUERIES:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        release(spark)
        print(f"{name}: {times[name]} s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": float(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
