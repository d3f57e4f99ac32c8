"""Headline timings: the segmentation run's queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf", ...}.
Each query is built from the tables and every column of its result is computed (the
``noop`` sink; an observation counts the rows on the way);
timings include planning and, for the first query of a dataset, building the shared
segmentation run (checkpointed features and thresholds).
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Observation  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from cohortlens.plans.catalog import REGISTRY  # noqa: E402
from cohortlens.session import get_spark  # noqa: E402

HEADLINE = [
    "raw_to_contract", "clean_events", "cleaning_audit", "data_quality", "customer_features",
    "customer_features_multi_asof", "chrono_split", "rule_thresholds", "segment_customers", "segment_counts",
    "explain_segment", "compare_segments", "recommend_conversion", "final_test_report", "boxplot_stats",
    "behavior_proxy", "mutual_information", "silhouette", "davies_bouldin", "route_queries",
    "annotate_events", "memory_search", "memory_profile", "memory_rerank",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=cpus)
    timings: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        t0 = time.perf_counter()
        df = REGISTRY[name](spark, sf_dir)
        seen = Observation(name)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        rows[name] = seen.get["n"]
        timings[name] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "segmentation_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "rows": rows, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "spark": spark.version, "master": f"local[{cpus}]",
    }))


if __name__ == "__main__":
    main()
