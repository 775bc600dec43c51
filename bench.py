"""Time the headline queries and print one JSON line.

Each query is run twice over the whole tables and written to the ``noop`` sink; the faster run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pactscope.plans.queries import QUERIES
from pactscope.session import build_session

HEADLINE = (
    "effective_responses",
    "operation_responses",
    "reachable_types",
    "recursive_types",
    "flatten_embedded",
    "flatten_routes",
    "summarize_blocks",
    "summarize_endpoints",
    "mine_directives",
    "mine_call_sites",
    "match_examples",
    "error_payload_examples",
    "schema_properties",
    "resolve_params",
    "attach_comments",
    "coverage_report",
    "document_parts",
    "latest_release",
    "word_forms",
)
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
