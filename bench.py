"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query is written to the `noop` sink, so all columns are computed. The time
of a query is the better of two runs after one warm-up query; it includes
building and planning the query. Questions asked of the audit table are timed on
a stored, day-partitioned table that is built once and not timed.

The bench tables are single files of one row group, so the inputs are dealt to all
cores first (`spanguard.inputPartitions`); that shuffle is part of the times.
"""

from __future__ import annotations

import json
import os
import time
from functools import partial

from spanguard.operators import audit as A
from spanguard.operators.paging import keyset_page
from spanguard.plans.catalog import QUERIES
from spanguard.plans.derived import AS_OF, INPUT_PARTITIONS, audit
from spanguard.session import local_session, shared_dir
from spanguard.sources import tables

HEADLINE = [
    "detections_by_decision",
    "regex_findings",
    "scan",
    "contextual_findings",
    "scan_all_passes",
    "evaluate_request",
    "build_audit",
    "confidence_heatmap",
    "histogram_quantile",
    "bench_summary",
    "text_to_bio",
    "match_spans",
    "entity_prf",
    "split_80_10_10",
    "assemble_batch",
    "assemble_stream",
]


AUDIT = {
    "audit_filter_entity": lambda t: A.filter_entity(t, "EMAIL"),
    "audit_search_text": lambda t: A.search_text(t, "example"),
    "audit_filter_log": lambda t: A.filter_log(t, ["BLOCK"], date_from="2024-01-10", date_to="2024-01-12"),
    "audit_keyset_page": lambda t: keyset_page(t, 50, ("2024-01-15 00:00:00", "")),
    "audit_stats_summary": lambda t: A.stats_summary(t, "7d", AS_OF),
    "audit_timeseries": lambda t: A.timeseries(t, "7d", "6h", AS_OF),
    "audit_top_entities": lambda t: A.top_entities(t, "7d", AS_OF),
}


def run(build) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = os.environ.get("BENCH_QUERIES", ",".join([*HEADLINE, *AUDIT])).split(",")
    spark = local_session(cores, "16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set(INPUT_PARTITIONS, str(spark.sparkContext.defaultParallelism))
    path = shared_dir(spark, "bench-audit")
    tables.write_audit(audit(spark, sf_dir), path, "bench")
    table = tables.read_audit(spark, path)
    jobs = {n: partial(QUERIES[n], spark, sf_dir) for n in names if n in QUERIES}
    jobs |= {n: partial(build, table) for n, build in AUDIT.items() if n in names}
    run(jobs[names[0]])
    seconds = {n: round(min(run(job) for _ in range(2)), 3) for n, job in jobs.items()}
    n_texts = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    result = {
        "metric": "total time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cores": cores,
    }
    if "scan" in seconds:
        result["scan_texts_per_sec"] = round(n_texts / seconds["scan"], 1)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
