"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local threads). Each query runs once to warm
up and once for the clock; its rows go to a sink that drops them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import ALL_QUERIES  # noqa: E402
from recordloom.session import local_session  # noqa: E402

HEADLINE = (
    "field_statistics",
    "value_index",
    "graph_triples",
    "gap_clusters",
    "similar_pairs",
    "dbscan_components",
    "normalize_all",
    "knn_documents",
    "knn_by_cells",
    "score_numeric",
    "accumulate",
    "candidate_rows",
    "key_value_search",
    "discover_relations",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "recordloom-bench", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            ALL_QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, warm",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
