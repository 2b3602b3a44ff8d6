"""Time the headline queries: one warm-up, then the median of three runs.

The receivables tables are derived from the order tables and stored once before
the clock starts, and so is the published store that the report queries read.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from duesight.checks.fixtures import raw_tables  # noqa: E402
from duesight.checks.queries import spark_query  # noqa: E402
from duesight.checks.store import store  # noqa: E402
from duesight.session import build_session, prepare  # noqa: E402

HEADLINE = [
    "snapshot_features",
    "score_linear",
    "customer_risk",
    "history_features",
    "score_page",
    "top_expected_loss",
    "publish_replace_partition",
]
RUNS = 3


def timed(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    spark_query(name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    raw = raw_tables(spark, sf_dir)
    store(spark, sf_dir)
    rows = {"invoice": raw.invoice.count(), "receipt": raw.receipt.count(), "customer": raw.customer.count()}
    queries = {}
    for name in HEADLINE:
        timed(spark, sf_dir, name)
        queries[name] = round(statistics.median(timed(spark, sf_dir, name) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "sf": sf_dir.rstrip("/").rpartition("sf")[2],
        "rows_in": rows,
        "spark": spark.version,
        "master": f"local[{cpus}]",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
