"""Questions asked of the audit table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanguard.functions.policy import effective_decision
from spanguard.functions.stats import nearest_rank, parse_duration, ts_lit
from spanguard.schema import SEVERITY

PERCENTILES = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}


# --- filters ------------------------------------------------------------------


def filter_time(audit: DataFrame, start=None, end=None) -> DataFrame:
    """Rows created within [start, end], both inclusive. Where the table has the
    `dt` partition column, whole days are skipped too.
    """
    for bound, op in ((start, "__ge__"), (end, "__le__")):
        if bound is not None:
            ts = ts_lit(bound)
            audit = audit.filter(getattr(F.col("created_at"), op)(ts))
            if "dt" in audit.columns:
                audit = audit.filter(getattr(F.col("dt"), op)(F.to_date(ts)))
    return audit


def filter_decision(audit: DataFrame, decision: str) -> DataFrame:
    """By the *input* decision; a record may show a worse effective one."""
    return audit.filter(F.col("input_decision") == decision.upper())


def filter_entity(audit: DataFrame, entity_type: str) -> DataFrame:
    has = lambda c: F.coalesce(F.map_contains_key(c, entity_type), F.lit(False))
    return audit.filter(has("input_redactions") | has("output_redactions"))


def _within(q: str) -> str:
    """Pattern of texts that hold `q`."""
    return "%" + q.replace("\\", "\\\\") + "%"


def search_text(audit: DataFrame, q: str, literal: bool = False) -> DataFrame:
    """Rows whose redacted prompt or response holds `q`. As in LIKE, % and _ are
    wildcards unless `literal`; a backslash is only itself.
    """
    if literal:
        hit = lambda c: F.col(c).contains(q)
    else:
        hit = lambda c: F.col(c).like(_within(q))
    either = F.coalesce(hit("prompt_redacted"), F.lit(False)) | F.coalesce(
        hit("response_redacted"), F.lit(False)
    )
    return audit.filter(either)


def filter_log(
    audit: DataFrame,
    decisions: Sequence[str] = (),
    user: str = "",
    model: str = "",
    date_from=None,
    date_to=None,
) -> DataFrame:
    """Log filter: decisions (none means all), partial user and model ignoring
    case, and a range of days.
    """
    audit = audit.filter(F.col("input_decision").isin(list(decisions) or SEVERITY))
    days = [F.to_date("created_at")] + ([F.col("dt")] if "dt" in audit.columns else [])
    for day in days:
        if date_from is not None:
            audit = audit.filter(day >= F.lit(date_from).cast("date"))
        if date_to is not None:
            audit = audit.filter(day <= F.lit(date_to).cast("date"))
    if user.strip():
        audit = audit.filter(F.col("user_id").ilike(_within(user.strip())))
    if model.strip():
        audit = audit.filter(F.col("model").ilike(_within(model.strip())))
    return audit


def nonempty_redactions(audit: DataFrame) -> DataFrame:
    return audit.filter(F.coalesce(F.size("input_redactions"), F.lit(0)) > 0)


# --- projections --------------------------------------------------------------


def entity_types_of(audit: DataFrame) -> Column:
    keys = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    return F.array_sort(F.array_union(keys("input_redactions"), keys("output_redactions")))


# The fields of the list view, in order.
_RECORD = [
    "id",
    "ts",
    "decision",
    "matched_rule_ids",
    "latency_ms",
    "detector_confidence",
    "entity_types",
    "request_preview",
    "tenant_id",
]
# What the detail view adds to them.
_DETAIL = [
    "input_decision",
    "output_decision",
    "model",
    "reasons",
    "input_redactions",
    "output_redactions",
    "prompt_redacted",
    "response_redacted",
    "detection_latency_ms",
    "llm_latency_ms",
    "total_latency_ms",
    "policy_id",
]


def audit_record(audit: DataFrame) -> DataFrame:
    """List view of audit rows."""
    return _with_record(audit).select(_RECORD)


def _with_record(audit: DataFrame) -> DataFrame:
    types = entity_types_of(audit)
    return audit.withColumns(
        {
            "ts": F.col("created_at"),
            "decision": effective_decision(),
            "matched_rule_ids": types,
            "entity_types": types,
            "latency_ms": F.col("total_latency_ms").cast("double"),
            "detector_confidence": F.lit(None).cast("double"),
            "request_preview": F.substring(
                F.coalesce("prompt_redacted", F.lit("")), 1, 200
            ),
            "tenant_id": F.col("user_id"),
        }
    )


def audit_detail(audit: DataFrame, value: str, column: str = "id") -> DataFrame:
    """One row by id (or request_id), with what the list view leaves out."""
    return (
        _with_record(audit.filter(F.col(column) == value))
        .withColumn("input_decision", F.lower("input_decision"))
        .withColumn("output_decision", F.lower("output_decision"))
        .select(*_RECORD, *_DETAIL)
    )


def latency_breakdown(audit: DataFrame) -> DataFrame:
    """Long form (request_id, stage, ms): detection, model, everything else."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    other = zero("total_latency_ms") - zero("detection_latency_ms") - zero("llm_latency_ms")
    return (
        audit.filter(
            F.col("detection_latency_ms").isNotNull() & F.col("total_latency_ms").isNotNull()
        )
        .select(
            "request_id",
            zero("detection_latency_ms").alias("detection"),
            zero("llm_latency_ms").alias("llm"),
            F.greatest(F.lit(0), other).alias("other"),
        )
        .unpivot("request_id", ["detection", "llm", "other"], "stage", "ms")
    )


# --- aggregates ---------------------------------------------------------------


def order_recent(audit: DataFrame, n: int) -> DataFrame:
    return audit.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def _since(audit: DataFrame, window: timedelta, as_of: datetime) -> DataFrame:
    return filter_time(audit, start=as_of - window)


_DECISIONS = ("allow", "mask", "block")


def _decision_parts() -> dict[str, Column]:
    return {d: effective_decision() == d for d in _DECISIONS}


def _or_zero(name: str, kind: str) -> Column:
    return F.coalesce(F.col(name).cast(kind), F.lit(0).cast(kind)).alias(name)


def stats_summary(audit: DataFrame, window: str, as_of: datetime) -> DataFrame:
    """Total, counts per effective decision and exact latency percentiles of the
    rows since `as_of` - `window` (there is no upper bound).
    """
    rows = _since(audit, parse_duration(window), as_of)
    ranks = nearest_rank(rows, "total_latency_ms", PERCENTILES, parts=_decision_parts())
    return ranks.select(
        F.lit(window).alias("window"),
        *[_or_zero(d, "long") for d in _DECISIONS],
        *[_or_zero(p, "double") for p in PERCENTILES],
    ).withColumn("total", F.col("allow") + F.col("mask") + F.col("block"))


def latency_percentiles(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    ranks = nearest_rank(rows, "total_latency_ms", PERCENTILES, keys)
    return ranks.select(*keys, *[_or_zero(p, "double") for p in PERCENTILES])


def _entity_totals(rows: DataFrame, *maps: str) -> DataFrame:
    """Sum per entity type over map columns, counted per task before the shuffle."""
    entries = F.concat(
        *[
            F.coalesce(
                F.map_entries(m), F.array().cast("array<struct<key:string,value:bigint>>")
            )
            for m in maps
        ]
    )
    return (
        rows.select(F.explode(entries).alias("e"))
        .groupBy(F.col("e.key").alias("entity_type"))
        .agg(F.sum("e.value").alias("n"))
    )


def top_entities(audit: DataFrame, window: str, as_of: datetime, k: int = 10) -> DataFrame:
    """Most redacted types of both sides; ties by name."""
    rows = _since(audit, parse_duration(window), as_of)
    totals = _entity_totals(rows, "input_redactions", "output_redactions")
    return totals.orderBy(F.desc("n"), "entity_type").limit(k)


def input_redaction_totals(audit: DataFrame) -> DataFrame:
    return _entity_totals(audit, "input_redactions")


def timeseries(audit: DataFrame, window: str, bucket: str, as_of: datetime) -> DataFrame:
    """Dense buckets from `as_of` - `window` on; rows past the last one count in
    it. Each has the counts per effective decision and the exact p95.
    """
    span, step = parse_duration(window), parse_duration(bucket)
    if step <= timedelta(0) or step > span:
        raise ValueError("bucket must be > 0 and <= window")
    since, n = as_of - span, max(1, int(span / step) + 1)
    micros = F.unix_micros(F.col("created_at")) - F.unix_micros(ts_lit(since))
    step_us = step // timedelta(microseconds=1)
    index = F.least(F.lit(n - 1), F.floor(micros / F.lit(step_us)).cast("int"))
    rows = _since(audit, span, as_of).withColumn("i", index)
    points = nearest_rank(
        rows, "total_latency_ms", {"p95_ms": 0.95}, ["i"], _decision_parts()
    )
    spine = audit.sparkSession.range(n).select(F.col("id").cast("int").alias("i"))
    start = F.timestamp_micros(F.unix_micros(ts_lit(since)) + F.col("i") * F.lit(step_us))
    return spine.join(points, "i", "left").select(
        start.alias("bucket"),
        *[_or_zero(d, "long") for d in _DECISIONS],
        _or_zero("p95_ms", "double"),
    )


def count_by_input_decision(audit: DataFrame) -> DataFrame:
    return audit.groupBy("input_decision").agg(F.count(F.lit(1)).alias("n"))


def total_requests(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count(F.lit(1)).alias("n"))


def daily_counts(audit: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    rows = _since(audit, timedelta(days=days), as_of)
    return rows.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )


def avg_latencies(audit: DataFrame) -> DataFrame:
    return audit.filter(F.col("total_latency_ms").isNotNull()).agg(
        *[
            F.round(F.avg(f"{s}_latency_ms"), 1).alias(f"avg_{s}_ms")
            for s in ("detection", "llm", "total")
        ]
    )


def log_summary(log: DataFrame) -> DataFrame:
    """Rows, mean latency and share of blocked rows of a filtered log."""
    blocked = F.count_if(F.col("input_decision") == "BLOCK")
    return log.agg(
        F.count(F.lit(1)).alias("records"),
        F.avg("total_latency_ms").alias("avg_latency_ms"),
        (blocked / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100).alias("block_pct"),
    )


def block_rate(audit: DataFrame, window: str, as_of: datetime) -> DataFrame:
    """Share of effectively blocked rows in percent, null without rows."""
    rows = _since(audit, parse_duration(window), as_of)
    blocked = F.count_if(effective_decision() == "block")
    total = F.nullif(F.count(F.lit(1)), F.lit(0))
    return rows.agg(F.round(blocked / total * 100, 1).alias("block_rate"))
