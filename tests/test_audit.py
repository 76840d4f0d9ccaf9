"""Audit questions: filters, pages, summaries, series, histograms."""

import random
from datetime import datetime, timedelta

import pytest

from spanguard.functions.stats import histogram_quantile, nearest_rank, parse_duration
from spanguard.operators import audit as A
from spanguard.operators import metrics as M
from spanguard.operators.paging import keyset_page, page_cursor
from spanguard.schema import AUDIT
from spanguard.sources import tables

NOW = datetime(2024, 1, 31)


def row(i, decision="ALLOW", ms=10, at=NOW, given=None, answered=None, **other):
    base = {
        "id": f"id{i:04d}", "request_id": f"r{i}", "created_at": at, "user_id": "anonymous",
        "model": "test-model", "input_decision": decision, "output_decision": None,
        "policy_id": "default-v1", "reasons": ["test reason"], "input_redactions": given or {},
        "output_redactions": answered or {}, "prompt_redacted": "[user]: hello",
        "response_redacted": None, "prompt_hash": "0" * 64, "detection_latency_ms": ms,
        "llm_latency_ms": None, "total_latency_ms": ms,
    }
    return {**base, **other}


def table(spark, rows):
    return spark.createDataFrame(rows, AUDIT)


FOUR = [
    row(1, "ALLOW", 10),
    row(2, "MASK", 20, given={"EMAIL": 1}),
    row(3, "MASK", 30, given={"EMAIL": 1}, answered={"SSN": 1}),
    row(4, "BLOCK", 100),
]


def test_summary(spark):
    got = A.stats_summary(table(spark, FOUR), "24h", NOW).first()
    assert (got.total, got.allow, got.mask, got.block) == (4, 1, 2, 1)
    assert (got.p50_ms, got.p95_ms, got.p99_ms) == (30.0, 100.0, 100.0)
    top = A.top_entities(table(spark, FOUR), "24h", NOW).collect()
    assert [tuple(r) for r in top] == [("EMAIL", 2), ("SSN", 1)]


def test_summary_without_rows(spark):
    got = A.stats_summary(table(spark, FOUR), "24h", NOW + timedelta(days=9)).first()
    assert (got.total, got.allow, got.p50_ms) == (0, 0, 0.0)
    assert A.block_rate(table(spark, FOUR), "1h", NOW + timedelta(days=9)).first()[0] is None


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 100, 3001])
def test_percentiles_equal_the_formula(spark, n):
    rng = random.Random(n)
    values = [rng.randint(0, 5000) for _ in range(n)]
    ps = {"a": 0.5, "b": 0.95, "c": 0.99}
    df = spark.createDataFrame([(v,) for v in values], "v int")
    ranked = sorted(values)
    want = tuple(ranked[max(0, min(n - 1, round(p * (n - 1))))] for p in ps.values())
    assert tuple(nearest_rank(df, "v", ps).first()) == want


def test_percentiles_per_key_keep_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 9), (None, 5), ("b", None)], "k string, v int")
    got = {r.k: r.p for r in nearest_rank(df, "v", {"p": 0.99}, ["k"]).collect()}
    assert got == {"a": 9, None: 5}


def test_series(spark):
    assert A.timeseries(table(spark, FOUR[:0] or [row(1)]), "1h", "10m", NOW).count() == 7
    late = table(spark, [row(1, "BLOCK", 7, NOW + timedelta(hours=5))])
    points = A.timeseries(late, "10m", "5m", NOW).orderBy("bucket").collect()
    assert [p.block for p in points] == [0, 0, 1]
    assert [p.p95_ms for p in points] == [0.0, 0.0, 7.0]
    assert points[0].bucket == NOW - timedelta(minutes=10)


@pytest.mark.parametrize("window, bucket", [("bogus", "5m"), ("5m", "1h"), ("5m", "0m")])
def test_bad_windows(spark, window, bucket):
    with pytest.raises(ValueError):
        A.timeseries(table(spark, FOUR), window, bucket, NOW)


def test_durations():
    assert parse_duration(" 90s ") == timedelta(seconds=90)
    assert parse_duration("7d") == timedelta(days=7)
    for bad in ("5", "m", "-1h", "1w", ""):
        with pytest.raises(ValueError):
            parse_duration(bad)


def test_pages_have_no_duplicates(spark):
    rows = [row(i, at=NOW - timedelta(seconds=i // 2)) for i in range(5)]
    df, cursor, seen = table(spark, rows), None, []
    for _ in range(4):
        page = keyset_page(df, 2, cursor)
        seen += [r.id for r in page.collect()[:2]]
        cursor = page_cursor(page, 2)
        if cursor is None:
            break
    assert seen == ["id0001", "id0000", "id0003", "id0002", "id0004"]
    with pytest.raises(ValueError):
        keyset_page(df, 201)


def test_filters(spark):
    rows = [
        row(1, "MASK", given={"EMAIL": 2}, prompt_redacted="[user]: Boston"),
        row(2, "ALLOW", answered={"SSN": 1}, response_redacted="summarize", output_decision="MASK"),
        row(3, "BLOCK", user_id="Alice", model="GPT", at=NOW - timedelta(days=2)),
    ]
    df = table(spark, rows)
    ids = lambda out: sorted(r.request_id for r in out.collect())
    assert ids(A.filter_entity(df, "EMAIL")) == ["r1"]
    assert ids(A.filter_entity(df, "SSN")) == ["r2"]
    assert ids(A.search_text(df, "Boston")) == ["r1"]
    assert ids(A.search_text(df, "s_mmar")) == ["r2"]
    assert ids(A.search_text(df, "s_mmar", literal=True)) == []
    # Shown as mask, found under allow.
    assert ids(A.filter_decision(df, "allow")) == ["r2"]
    assert [r.decision for r in A.audit_record(A.filter_decision(df, "allow")).collect()] == ["mask"]
    assert ids(A.filter_time(df, NOW, NOW)) == ["r1", "r2"]
    assert ids(A.filter_log(df, user="aLi", model="gp")) == ["r3"]
    assert ids(A.filter_log(df, ["MASK"], date_from="2024-01-30")) == ["r1"]
    assert ids(A.nonempty_redactions(df)) == ["r1"]
    detail = A.audit_detail(df, "r2", "request_id").first()
    assert (detail.decision, detail.input_decision, detail.output_decision) == ("mask", "allow", "mask")
    assert detail.entity_types == ["SSN"]
    summary = A.log_summary(df).first()
    assert (summary.records, round(summary.block_pct, 1)) == (3, 33.3)


def test_round_trip_and_csv(spark, tmp_path):
    df = table(spark, FOUR)
    path = str(tmp_path / "audit")
    tables.write_audit(df, path)
    tables.write_audit(table(spark, [row(5, at=NOW - timedelta(days=1))]), path)
    back = tables.read_audit(spark, path)
    assert back.count() == 5
    assert A.filter_time(back, NOW).count() == 4
    plan = A.filter_time(back, NOW)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    tables.export_csv(df, str(tmp_path / "csv"))
    text = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {r.input_redactions for r in text.collect()} == {"{}", '{"EMAIL":1}'}


def test_histogram_and_quantile(spark):
    rows = [row(i, ms=ms) for i, ms in enumerate([4, 5, 6, 90, 20_000])]
    hist = M.latency_histogram(table(spark, rows), "request")
    counts = {r.le: r.cumulative for r in hist.collect()}
    assert (counts["0.005"], counts["0.01"], counts["0.1"], counts["10.0"]) == (2, 3, 4, 4)
    assert counts["+Inf"] == 5
    got = histogram_quantile(hist, {"p40": 0.4, "p50": 0.5, "p99": 0.99}).first()
    assert got.p40 == pytest.approx(0.005)
    assert got.p50 == pytest.approx(0.005 + 0.005 * 0.5)
    assert got.p99 == 10.0


def test_bench_summary(spark):
    rng = random.Random(0)
    rows = [(10, rng.random() * 100, 200, "MASK") for _ in range(301)] + [(10, 1e6, None, None)]
    rows += [(50, None, None, None)]
    df = spark.createDataFrame(
        rows, "concurrency int, latency_ms double, status int, decision string"
    )
    got = {r.concurrency: r for r in M.bench_summary(df, 20.0).collect()}
    ranked = sorted(r[1] for r in rows[:301])
    assert (got[10].total_requests, got[10].errors, got[10].mask) == (301, 1, 301)
    assert got[10].p95_ms == round(ranked[round(0.95 * 300)], 2)
    assert got[10].max_ms == round(ranked[-1], 2)
    assert (got[50].total_requests, got[50].p50_ms, got[50].max_ms) == (0, 0.0, 0.0)
