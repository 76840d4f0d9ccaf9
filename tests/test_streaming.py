"""Streamed responses and audit streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanguard.sources import versions
from spanguard.streaming import jobs as J
from spanguard.streaming import responses as S

LINES = "request_id string, seq bigint, ts timestamp, line string"
T0 = datetime(2024, 1, 1)


def chunk(content=None, reason=None, **extra):
    choice = {"index": 0, "delta": {"content": content} if content is not None else {}}
    body = {"id": "c1", "created": 5, "model": "m", "choices": [{**choice, "finish_reason": reason}]}
    return "data: " + json.dumps({**body, **extra})


def lines(request_id, texts, start=0):
    return [(request_id, i, T0 + timedelta(seconds=start + i), t) for i, t in enumerate(texts)]


def stream(spark, tmp_path, batches):
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, name):
    return df.sparkSession.read.parquet(J.run_to_parquet(df, name))


SPLIT = [
    ": comment",
    chunk("mail me at a@"),
    "data: {broken",
    "data: {}",
    chunk("b.co today"),
    chunk(None, "length"),
    "data: [DONE]",
    chunk("ignored"),
]


def test_parse_keeps_chunks_without_choices(spark):
    df = spark.createDataFrame(lines("a", SPLIT), LINES)
    kinds = [r.kind for r in S.read_sse_lines(df).orderBy("seq").collect()]
    assert kinds == ["skip", "chunk", "skip", "chunk", "chunk", "chunk", "done", "chunk"]


def test_response_out_of_order_over_batches(spark, tmp_path):
    rows = lines("a", SPLIT)
    source = stream(spark, tmp_path, [rows[4:], rows[1:4] + lines("open", SPLIT[:3]), rows[:1]])
    out = drain(S.assemble_stream(S.read_sse_lines(source)), "t").collect()
    assert [(r.request_id, r.status) for r in out] == [("a", "done")]
    assert (out[0].content, out[0].finish_reason) == ("mail me at a@b.co today", "length")
    assert len(out[0].chunks) == 4


def test_abandoned_response(spark, tmp_path):
    late = lines("b", [chunk("x"), "data: [DONE]"], start=7200)
    source = stream(spark, tmp_path, [lines("a", SPLIT[:3]), late, lines("c", [chunk("y")], 7300)])
    out = drain(S.assemble_stream(S.read_sse_lines(source)), "t").collect()
    assert {(r.request_id, r.status, r.content) for r in out} == {
        ("a", "abandoned", "mail me at a@"),
        ("b", "done", "x"),
    }


def test_lines_after_the_end_in_a_later_batch(spark, tmp_path):
    rows = lines("a", SPLIT)
    much_later = lines("b", [chunk("x"), "data: [DONE]"], start=7200)
    batches = [rows[:7], rows[7:] + rows[:2], much_later, lines("c", [chunk("y")], 7300)]
    out = drain(S.assemble_stream(S.read_sse_lines(stream(spark, tmp_path, batches))), "t").collect()
    assert sorted((r.request_id, r.status) for r in out) == [("a", "done"), ("b", "done")]


def test_restart_from_a_checkpoint(spark, tmp_path):
    rows, path, checkpoint = lines("a", SPLIT), str(tmp_path / "out"), str(tmp_path / "cp")
    for part in (rows[:4], rows[4:], lines("b", [chunk("z"), "data: [DONE]"], start=30)):
        source = stream(spark, tmp_path, [part])
        J.run_to_parquet(S.assemble_stream(S.read_sse_lines(source)), "t", (), path, checkpoint)
    out = {(r.request_id, r.content) for r in spark.read.parquet(path).collect()}
    assert out == {("a", "mail me at a@b.co today"), ("b", "z")}


def test_audit_rows_are_appended_once_however_late(spark, tmp_path):
    schema = "request_id string, created_at timestamp"
    path, checkpoint, source = (str(tmp_path / n) for n in ("out", "cp", "in"))
    day = timedelta(days=1)
    for rows in ([("a", T0), ("a", T0), ("b", T0 + 40 * day)], [("c", T0 - 90 * day), ("a", T0)], [("b", T0 + 40 * day), ("d", T0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        J.append_audit(spark.readStream.schema(schema).parquet(source), path, checkpoint)
    found = J.read_appended(spark, path, spark.createDataFrame([], schema).schema)
    assert sorted(r.request_id for r in found.collect()) == ["a", "b", "c", "d"]


def test_a_request_id_is_unique_over_all_days_and_restarts(spark, tmp_path, monkeypatch):
    schema = "request_id string, created_at timestamp, n int"
    path, checkpoint, source = (str(tmp_path / n) for n in ("out", "cp", "in"))
    day, want = timedelta(days=1), {}
    monkeypatch.setattr(J, "_id_index", lambda s, p: versions.BatchTable(s, f"{p}/_ids", J._IDS, every=2, partition_by=("bucket",)))
    for k in range(6):
        rows = [(f"r{i}", T0 + (i * k % 5) * day, i + k) for i in range(3 * k, 3 * k + 9)] + [(f"r{3 * k}", T0 - day, 0), (None, T0, k)]
        for r in sorted(rows, key=lambda r: (r[1], r[2])):
            want.setdefault(r[0], r)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        J.append_audit(spark.readStream.schema(schema).parquet(source), path, checkpoint)
    found = J.read_appended(spark, path, spark.createDataFrame([], schema).schema).collect()
    assert sorted(map(str, [(r.request_id, r.created_at, r.n) for r in found])) == sorted(map(str, want.values()))
    names = versions._names(spark, f"{path}/_ids")
    assert len([n for n in names if n.startswith("upto")]) == 2 and len([n for n in names if n.startswith("batch")]) <= 4


def test_folders_of_a_batch_table_stay_few(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, n bigint").schema
    merge = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    table = versions.BatchTable(spark, str(tmp_path / "t"), schema, merge, every=3)
    assert not table.exists() and table.read().count() == 0
    for number in range(14):
        for _ in range(2 if number in (5, 7) else 1):  # repeated after a failure, with a snapshot and without
            table.write(spark.createDataFrame([("a", number), (f"k{number}", 1)], schema), number)
        assert merge(table.read()).filter("k = 'a'").first().n == sum(range(number + 1))
        assert merge(table.read(number)).filter("k = 'a'").count() == (number > 0)
        assert len(versions._names(spark, table.path)) <= 2 + 6
    assert merge(table.read()).count() == 15


def test_versions_and_conflicts(spark, tmp_path):
    path = str(tmp_path / "rules")
    schema = spark.createDataFrame([], "x int").schema
    assert versions.newest_version(spark, path) == 0 and versions.read_version(spark, path, schema).count() == 0
    for base, rows in ((0, [1]), (1, [1, 2])):
        assert versions.write_version(spark.createDataFrame([(x,) for x in rows], schema), path, base) == base + 1
    with pytest.raises(versions.VersionConflict):
        versions.write_version(spark.createDataFrame([(9,)], schema), path, 1)
    slow = versions.newest_version
    try:  # another writer comes in between the check and the marker
        versions.newest_version = lambda *_: 1
        with pytest.raises(versions.VersionConflict):
            versions.write_version(spark.createDataFrame([(9,)], schema), path, 1)
    finally:
        versions.newest_version = slow
    assert [versions.read_version(spark, path, schema, v).count() for v in (1, 2, None)] == [1, 2, 2]


def test_late_rows_are_counted_apart(spark, tmp_path):
    schema = "created_at timestamp, input_decision string, output_decision string"
    counts, rejects, checkpoint, source = (str(tmp_path / n) for n in ("out", "late", "cp", "in"))
    for batch in ((1, 20), (2, 9, 10, 30), (8, 16, 31)):
        rows = [(T0 + timedelta(minutes=m), "ALLOW", None) for m in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        J.count_by_window(spark.readStream.schema(schema).parquet(source), counts, rejects, "5m", "10m", checkpoint)
    got = lambda p: {(r.window_start.minute, r.n) for r in J.window_counts(spark, p).collect()}
    assert got(counts) == {(0, 1), (20, 1), (10, 1), (30, 2)} and got(rejects) == {(0, 1), (5, 2), (15, 1)}


def test_metrics_show_open_windows(spark, tmp_path):
    schema = "created_at timestamp, input_decision string, output_decision string"
    path, checkpoint, source = (str(tmp_path / n) for n in ("out", "cp", "in"))
    for minutes in (1, 2, 7):
        rows = [(T0 + timedelta(minutes=minutes), "ALLOW", None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        J.run_live_metrics(J.live_metrics(spark.readStream.schema(schema).parquet(source)), path, checkpoint)
    got = {(r.window_start.minute, r.n) for r in J.latest_metrics(spark, path).collect()}
    assert got == {(0, 2), (5, 1)}


def test_batch_assembly_equals_stream(spark, tmp_path):
    rows = lines("a", SPLIT) + lines("b", [chunk("only"), chunk(None, "stop"), "data: [DONE]"])
    rows += lines("never", [chunk("lost")])
    parsed = S.read_sse_lines(spark.createDataFrame(rows, LINES))
    batch = {(r.request_id, r.content, r.finish_reason) for r in S.assemble_batch(parsed).collect()}
    out = drain(S.assemble_stream(S.read_sse_lines(stream(spark, tmp_path, [rows]))), "t")
    assert batch == {(r.request_id, r.content, r.finish_reason) for r in out.collect()}


def emitted(spark, content_lines):
    rows = lines("a", content_lines)
    parsed = S.read_sse_lines(spark.createDataFrame(rows, LINES))
    whole = S.assemble_batch(parsed)
    chunks = (
        parsed.filter("kind = 'chunk'")
        .groupBy("request_id")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("c"))
        .select("request_id", F.col("c.payload").alias("chunks"))
    )
    scanned = S.stream_metadata(S.scan_stream(whole.join(chunks, "request_id")))
    out = S.reemit(scanned, "ppg").orderBy("seq").collect()
    assert out[-1].line == "data: [DONE]"
    return [json.loads(r.line[6:]) for r in out[:-1]]


def test_redacted_response_is_two_chunks(spark):
    two = emitted(spark, [chunk("to a@"), chunk("b.co"), chunk(None, "stop"), "data: [DONE]"])
    assert [c["choices"][0]["finish_reason"] for c in two] == [None, "stop"]
    assert two[0]["choices"][0]["delta"] == {"content": "to [REDACTED_EMAIL]"}
    assert two[1]["choices"][0]["delta"] == {}
    assert (two[0]["id"], two[0]["created"], two[0]["model"]) == ("c1", 5, "m")
    assert two[1]["ppg"]["output_decision"] == "MASK"
    assert two[1]["ppg"]["output_redactions"] == {"EMAIL": 1}
    assert "ppg" not in two[0]


def test_clean_response_keeps_its_chunks(spark):
    sent = [chunk("fine", extra=1), chunk(None, "stop"), "data: [DONE]"]
    out = emitted(spark, sent)
    assert out[0] == json.loads(sent[0][6:])
    assert out[1].pop("ppg")["output_decision"] == "ALLOW"
    assert out[1] == json.loads(sent[1][6:])


def test_failures(spark):
    rows = [("a", "timeout"), ("b", "ok"), ("c", "connect_error"), ("d", None)]
    df = S.failed_streams(spark.createDataFrame(rows, "id string, status string"))
    got = {(r.id, r.error_type) for r in df.collect()}
    assert got == {("a", "timeout"), ("c", "connection_error")}


class FakeHandle:
    """State of one response, counting what is written."""

    def __init__(self):
        self.marks, self.rows, self.appended, self.timers = [], [], [], set()

    def getValueState(self, name, schema):  # noqa: N802
        marks = self.marks

        class Value:
            exists = staticmethod(lambda: bool(marks))
            get = staticmethod(lambda: marks[0])
            update = staticmethod(lambda v: marks.__setitem__(slice(None), [v]))
            clear = staticmethod(marks.clear)

        return Value

    def getListState(self, name, schema):  # noqa: N802
        handle = self

        class Lines:
            get = staticmethod(lambda: iter(handle.rows))
            clear = staticmethod(handle.rows.clear)

            @staticmethod
            def appendList(values):  # noqa: N802
                handle.appended.append(len(values))
                handle.rows.extend(values)

        return Lines

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


def test_a_batch_writes_only_its_own_lines():
    import random

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)  # noqa: N815

    r = random.Random(2)
    for _ in range(200):
        n = r.randint(0, 30)
        rows = [(i, "done" if i == n else "chunk", f"p{i}", f"c{i} ", "stop" if i == n - 1 else None) for i in range(n + 4)]
        sent = [x for x in rows for _ in range(r.randint(0 if r.random() < 0.02 else 1, 2))]
        r.shuffle(sent)
        handle, out, fresh, seen = FakeHandle(), [], [], set()
        assembler = S.Assembler(1000)
        assembler.init(handle)
        while sent:
            size = r.randint(1, 8)
            batch, sent = sent[:size], sent[size:]
            names = ("seq", "kind", "payload", "content", "finish_reason", "_ms")
            closed = bool(out)
            out += assembler.handleInputRows(("a",), iter([dict(zip(names, (*x, 5))) for x in batch]), Times)
            new = {x[0] for x in batch} - seen
            if not closed and new:
                fresh.append(len(new))
                seen |= new
            assert len(handle.timers) == 1
        assert handle.appended == fresh
        if set(range(n + 1)) <= seen:
            assert len(out) == 1 and out[0].status == "done"
            assert out[0].content == "".join(f"c{i} " for i in range(n)) and len(out[0].chunks) == n
            assert handle.rows == []
        else:
            assert out == []
            left = list(assembler.handleExpiredTimer(("a",), Times, None))
            assert [x.status for x in left] == ["abandoned"] and handle.rows == [] and handle.marks == []


def test_a_batch_of_documents_has_a_file_per_core(spark, sf, tmp_path, monkeypatch):
    from spanguard.plans import derived, streams

    run, checkpoint = J.run_to_parquet, tmp_path / "checkpoint"
    monkeypatch.setattr(J, "run_to_parquet", lambda df, name: run(df, name, checkpoint=str(checkpoint)))
    spark.conf.set(derived.INPUT_PARTITIONS, spark.sparkContext.defaultParallelism)
    try:
        assert all(r.differing == 0 for r in streams.stream_equals_batch(spark, sf).collect())
    finally:
        spark.conf.unset(derived.INPUT_PARTITIONS)
    assert len([f for f in (checkpoint / "commits").iterdir() if f.name.isdigit()]) == 1
