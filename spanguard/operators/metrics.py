"""Counters, histograms and rates over audit rows and findings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanguard.functions.stats import (
    histogram,
    histogram_quantile,
    nearest_rank,
    parse_duration,
    ts_lit,
)
from spanguard.schema import CONFIDENCE_BOUNDS, LATENCY_BOUNDS


def requests_total(audit: DataFrame) -> DataFrame:
    """Requests per input decision."""
    return audit.groupBy(F.col("input_decision").alias("decision")).agg(
        F.count(F.lit(1)).alias("n")
    )


def detections_total(findings: DataFrame) -> DataFrame:
    """Input findings (long form) per type and detector."""
    return findings.groupBy("entity_type", "detector").agg(F.count(F.lit(1)).alias("n"))


def blocks_total(actionable: DataFrame) -> DataFrame:
    """Actionable findings (long form, with the `input_decision` of their
    request) of blocked requests, whatever their own rule says.
    """
    return (
        actionable.filter(F.col("input_decision") == "BLOCK")
        .groupBy("entity_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confidence_histogram(findings: DataFrame, keys: Sequence[str] = ("detector",)) -> DataFrame:
    return histogram(findings, F.col("confidence"), CONFIDENCE_BOUNDS, keys)


def latency_histogram(audit: DataFrame, stage: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts of one stage (detection, llm, request), in seconds."""
    column = {"detection": "detection", "llm": "llm", "request": "total"}[stage]
    seconds = F.col(f"{column}_latency_ms") / F.lit(1000.0)
    return histogram(audit, seconds, LATENCY_BOUNDS[stage], keys)


def window_start(ts: str, window: str) -> Column:
    seconds = int(parse_duration(window).total_seconds())
    return F.window(F.col(ts), f"{seconds} seconds")["start"]


def rate_by_window(audit: DataFrame, window: str = "5m") -> DataFrame:
    """Requests per second per tumbling window and input decision."""
    seconds = parse_duration(window).total_seconds()
    return audit.groupBy(
        window_start("created_at", window).alias("window_start"), "input_decision"
    ).agg((F.count(F.lit(1)) / F.lit(seconds)).alias("rate"))


def latency_quantiles(audit: DataFrame, window: str, stage: str = "request") -> DataFrame:
    """p50, p95 and p99 per window, estimated from the histogram."""
    rows = audit.withColumn("window_start", window_start("created_at", window))
    hist = latency_histogram(rows, stage, ["window_start"])
    return histogram_quantile(
        hist, {"p50": 0.50, "p95": 0.95, "p99": 0.99}, ["window_start"]
    )


def topk_increase(
    findings: DataFrame, start: datetime, end: datetime, k: int = 10, ts: str = "created_at"
) -> DataFrame:
    """Entity types with most findings in [start, end)."""
    inside = (F.col(ts) >= ts_lit(start)) & (F.col(ts) < ts_lit(end))
    totals = findings.filter(inside).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
    return totals.orderBy(F.desc("n"), "entity_type").limit(k)


def confidence_heatmap(findings: DataFrame, window: str, ts: str = "created_at") -> DataFrame:
    """Confidence buckets per window."""
    rows = findings.withColumn("window_start", window_start(ts, window))
    return confidence_histogram(rows, ["window_start"])


def bench_summary(results: DataFrame, duration_s: Column | float) -> DataFrame:
    """Load-test results (concurrency, latency_ms, status, decision) per level.

    Requests with a null status never got an answer: they count as errors and
    not as requests. Latencies are ranked in hundredths of a millisecond, the
    precision they are reported in, which keeps the order.
    """
    done = F.col("status").isNotNull()
    duration = duration_s if isinstance(duration_s, Column) else F.lit(float(duration_s))
    counts = results.groupBy("concurrency").agg(
        F.count_if(done).alias("total_requests"),
        F.count_if(~done).alias("errors"),
        F.round(F.count_if(done) / duration, 1).alias("requests_per_sec"),
        F.coalesce(F.round(F.max(F.when(done, F.col("latency_ms"))), 2), F.lit(0.0)).alias(
            "max_ms"
        ),
        *[
            F.count_if(done & (F.col("decision") == d)).alias(d.lower())
            for d in ("ALLOW", "MASK", "BLOCK")
        ],
    )
    cents = results.filter(done).withColumn(
        "_cents", F.round(F.col("latency_ms") * 100).cast("long")
    )
    ps = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}
    ranks = nearest_rank(cents, "_cents", ps, ["concurrency"])
    return counts.join(ranks, "concurrency", "left").select(
        *counts.columns, *[F.coalesce(F.col(p) / 100, F.lit(0.0)).alias(p) for p in ps]
    )
