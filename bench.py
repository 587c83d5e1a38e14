"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. The
input comes as one row group a table, which a single task would read; it is written once, before
the clock starts, as one file a core, as any large table would be. Each query runs once to warm
up and is then timed three times, each time in another order; its figure is the median. Results
are consumed on the executors.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from checks.queries import QUERIES
from medwarden.session import local_session

HEADLINE = [
    "signal_prr",
    "signal_relative_rate",
    "unified_prr",
    "fact_adverse_event",
    "fact_ae_calls",
    "analytics_view",
    "cases_by_drug",
    "metric_query",
    "safety_headline",
    "onset_by_drug",
    "drug_severity_matrix",
    "triage_sorted",
    "extract_fields",
    "enrich_narratives",
    "call_intelligence",
    "extract_adverse_events",
    "sentiment",
    "keyword_search",
    "search_batch",
    "vector_search",
    "hybrid_search",
    "ingest_json_batches",
    "dq_report",
    "function_health",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def laid_out(spark, sf_dir: str, files: int) -> str:
    """The tables of ``sf_dir`` in a new folder, each as ``files`` files."""
    out = tempfile.mkdtemp(prefix="bench-")
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            rows = spark.read.parquet(f"{sf_dir}/{name}")
            rows.repartition(files).write.parquet(f"{out}/{name}")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "12g"))
    tables = laid_out(spark, sf_dir, int(cpus))
    for name in HEADLINE:
        run(spark, name, tables)
    times = {name: [] for name in HEADLINE}
    for turn in range(3):
        at = turn * len(HEADLINE) // 3
        for name in HEADLINE[at:] + HEADLINE[:at]:
            times[name].append(run(spark, name, tables))
    seconds = {name: round(statistics.median(t), 3) for name, t in times.items()}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
