"""Registered queries: request bodies, event lines and streaming jobs.

Streams are drained with `availableNow` into tables of the shared folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanguard.operators import rules
from spanguard.operators.scan import scan
from spanguard.plans import derived as D
from spanguard.plans import oracle as O
from spanguard.plans.audits import _OUT
from spanguard.plans.registry import counts_text, query, stamp_col
from spanguard.schema import AUDIT
from spanguard.session import shared_dir
from spanguard.sources import tables
from spanguard.sources.versions import VersionConflict, newest_version
from spanguard.streaming import jobs as J
from spanguard.streaming import responses as S

# --- request bodies ---------------------------------------------------------------


def request_bodies(spark, sf):
    """Conversations as JSON request bodies with a field nobody knows, in the
    body and in each message; every eleventh is broken, every seventeenth lacks
    its messages.
    """
    messages = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))),
        lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["turn"].alias("weight")),
    )
    conv = F.col("conv_id")
    head = [
        F.lit("chat-1").alias("model"),
        F.when(conv % 2 == 0, F.concat(F.lit("user"), conv.cast("string"))).alias("user"),
        conv.alias("trace"),
    ]
    body = F.to_json(F.struct(*head, "messages"))
    bodies = D.table(spark, sf, "conversations").groupBy("conv_id").agg(messages.alias("messages"))
    return bodies.select(
        F.when(conv % 11 == 3, body.substr(F.lit(1), F.length(body) - 1))
        .when(conv % 17 == 4, F.to_json(F.struct(*head)))
        .otherwise(body)
        .alias("value")
    )


@query(
    "read_requests",
    "select 'chat-1' as model, case when conv_id % 2 = 0 then 'user' || conv_id end as \"user\","
    " cast(conv_id as varchar) as trace, idx, role, text as content, cast(turn as varchar) as weight from"
    " (select conv_id, role, text, turn, row_number() over (partition by conv_id order by turn) - 1 as idx"
    " from conversations) where length(text) > 0 and conv_id % 11 <> 3 and conv_id % 17 <> 4",
)
def read_requests(spark, sf):
    path = shared_dir(spark, "requests")
    request_bodies(spark, sf).write.text(path)
    found = tables.read_requests(spark, path).withColumn("trace", F.try_element_at("extra", F.lit("trace")))
    rows = found.select("model", "user", "trace", F.posexplode("messages").alias("idx", "m"))
    return rows.filter(F.length("m.content") > 0).select(
        "model", "user", "trace", F.col("idx").cast("bigint").alias("idx"), "m.role", "m.content",
        F.try_element_at("m.extra", F.lit("weight")).alias("weight"),
    )


@query(
    "rejected_requests",
    "select case when conv_id % 11 = 3 then 'the body is no JSON object' else 'messages are missing or no list' end as reason,"
    " count(distinct conv_id) as n from conversations where conv_id % 11 = 3 or conv_id % 17 = 4 group by all",
)
def rejected_requests(spark, sf):
    path = shared_dir(spark, "requests")
    request_bodies(spark, sf).write.text(path)
    return tables.rejected_requests(spark, path).groupBy("reason").agg(F.count("*").alias("n"))


# --- event lines of responses -------------------------------------------------------

_PIECE = 40


def event_lines(spark, sf):
    """Each assistant turn as the lines of its stream (request_id, seq, ts,
    line): a comment, chunks of forty characters, a broken line, a last chunk
    with the finish reason, [DONE] and a chunk after the end.
    """
    pieces = F.expr(
        f"transform(sequence(0, cast(floor((length(content) - 1) / {_PIECE}) as int)),"
        f" i -> substring(content, i * {_PIECE} + 1, {_PIECE}))"
    )
    chunk = lambda delta, reason: F.concat(
        F.lit(S.PREFIX),
        F.to_json(
            F.struct(
                F.concat(F.lit("c-"), "request_id").alias("id"),
                F.lit("chat.completion.chunk").alias("object"),
                F.lit(1700000000).alias("created"),
                F.lit("chat-1").alias("model"),
                F.array(
                    F.struct(
                        F.lit(0).alias("index"),
                        F.struct(delta.alias("content")).alias("delta"),
                        reason.alias("finish_reason"),
                    )
                ).alias("choices"),
            )
        ),
    )
    none = F.lit(None).cast("string")
    lines = F.concat(
        F.array(F.lit(": keep-alive")),
        F.transform(pieces, lambda p: chunk(p, none)),
        F.array(
            F.lit(S.PREFIX + '{"choices": [{"delta"'),
            chunk(none, F.lit("stop")),
            F.lit(S.PREFIX + "[DONE]"),
            chunk(F.lit("too late"), none),
        ),
    )
    texts = D.choices(spark, sf).withColumn(
        "request_id", F.concat_ws("-", "request_id", F.col("idx").cast("string"))
    )
    rows = texts.select("request_id", F.posexplode(lines).alias("seq", "line"))
    return rows.select(
        "request_id",
        F.col("seq").cast("bigint").alias("seq"),
        F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, seq / 100)").alias("ts"),
        "line",
    )


_LINE_SQL = [
    O.CHOICES,
    "txt as (select conv_id || '-' || turn as request_id, text from choices)",
    f"n as (select request_id, text, (length(text) - 1) // {_PIECE} + 1 as pieces from txt)",
]


@query(
    "read_sse_lines",
    O.with_(*_LINE_SQL)
    + "select request_id, pieces + 2 as n_chunks, cast(1 as bigint) as n_done, cast(2 as bigint) as n_skipped,"
    " length(text) + 8 as n_chars from n",
)
def read_sse_lines(spark, sf):
    parsed = S.read_sse_lines(event_lines(spark, sf))
    return parsed.groupBy("request_id").agg(
        F.count_if(F.col("kind") == "chunk").alias("n_chunks"),
        F.count_if(F.col("kind") == "done").alias("n_done"),
        F.count_if(F.col("kind") == "skip").alias("n_skipped"),
        F.sum(F.length("content")).alias("n_chars"),
    )


_ASSEMBLED_SQL = (
    O.with_(*_LINE_SQL)
    + "select request_id, text as content, 'stop' as finish_reason, pieces + 1 as n_chunks from n"
)


@query("assemble_batch", _ASSEMBLED_SQL)
def assemble_batch(spark, sf):
    return S.assemble_batch(S.read_sse_lines(event_lines(spark, sf)))


def line_stream(spark, sf):
    """The event lines as a stream of three batches that split every response
    and deliver its later lines first.
    """
    path = shared_dir(spark, "lines")
    lines = event_lines(spark, sf).withColumn("part", F.lit(2) - F.col("seq") % 3)
    lines.repartition(3, "part").write.partitionBy("part").parquet(path)
    return (
        spark.readStream.schema("request_id string, seq bigint, ts timestamp, line string, part int")
        .option("maxFilesPerTrigger", 1)
        .parquet(path)
        .drop("part")
    )


def assembled(spark, sf):
    return S.assemble_stream(S.read_sse_lines(line_stream(spark, sf)))


@query("assemble_stream", _ASSEMBLED_SQL)
def assemble_stream(spark, sf):
    path = J.run_to_parquet(assembled(spark, sf), "assembled")
    return spark.read.parquet(path).select(
        "request_id", "content", "finish_reason", F.size("chunks").cast("bigint").alias("n_chunks")
    )


_SCANNED_SQL = [O.ENTITY_DIM, O.RULES, *_OUT]


@query(
    "scan_stream",
    O.with_(*_SCANNED_SQL)
    + "select conv_id || '-' || turn as request_id, decision, text as redacted_text from och",
)
def scan_stream(spark, sf):
    """Assembly and output scan in one streaming query: an entity that was
    spread over chunks is found.
    """
    scanned = S.scan_stream(assembled(spark, sf)).select(
        "request_id", "decision", "redacted_text"
    )
    return spark.read.parquet(J.run_to_parquet(scanned, "scanned"))


@query(
    "reemit",
    O.with_(*_SCANNED_SQL)
    + "select o.conv_id || '-' || o.turn as request_id,"
    f" case when o.decision <> 'ALLOW' then 3 else (length(c.text) - 1) // {_PIECE} + 3 end as n_lines,"
    " o.decision, case when o.decision <> 'ALLOW' then o.text else c.text end as content"
    " from och o join choices c on c.k = o.k",
)
def reemit(spark, sf):
    """Lines sent on, read again: as many as expected and with the safe text."""
    scanned = S.scan_stream(assembled(spark, sf)).drop("findings", "actionable")
    sent = S.reemit(S.stream_metadata(scanned), "ppg")
    lines = spark.read.parquet(J.run_to_parquet(sent, "reemitted"))
    parsed = S.read_sse_lines(lines)
    meta = F.get_json_object("payload", "$.ppg.output_decision")
    whole = S.assemble_batch(parsed).select("request_id", "content")
    return (
        parsed.groupBy("request_id")
        .agg(F.count("*").alias("n_lines"), F.max(meta).alias("decision"))
        .join(whole, "request_id")
    )


_FAILED = (
    "failed as (select ts, case event_id % 3 when 0 then 'timeout' when 1 then 'backend_error' else 'connection_error' end"
    " as error_type, case event_id % 3 when 0 then 'LLM backend timed out' when 1 then 'LLM backend error'"
    " else 'Cannot connect to LLM backend' end as message from events where event_type = 'error')"
)


@query(
    "failed_streams",
    O.with_(_FAILED)
    + f"select strftime(time_bucket(interval 1 hour, ts), {O.STAMP}) as window_start, error_type,"
    " any_value(message) as message, count(*) as n from failed group by all",
)
def failed_streams(spark, sf):
    """Error events as a stream of failed responses, counted by hour and cause."""
    causes = F.array(*[F.lit(c) for c, _, _ in S.FAILURES])
    status = F.when(
        F.col("event_type") == "error", F.get(causes, (F.col("event_id") % 3).cast("int"))
    ).otherwise("ok")
    events = D.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), status.alias("status")
    )
    source = shared_dir(spark, "responses")
    events.write.parquet(source)
    failed = S.failed_streams(spark.readStream.schema(events.schema).parquet(source))
    records = spark.read.schema(failed.schema).parquet(J.run_to_parquet(failed, "failures"))
    return J.failures_by_cause(records, "1h").select(
        stamp_col("window_start").alias("window_start"), "error_type", "message", "n"
    )


# --- streams of audit rows and texts -----------------------------------------------


def in_batches(spark, rows, run):
    """Call `run` with a stream of the rows that ends after each of their `part`s 0, 1, 2.

    The runs share their checkpoint, so each part is one batch.
    """
    parts, source = shared_dir(spark, "parts"), shared_dir(spark, "batches")
    rows.write.partitionBy("part").parquet(parts)
    schema = T.StructType([f for f in rows.schema.fields if f.name != "part"])
    for part in range(3):
        spark.read.schema(schema).parquet(f"{parts}/part={part}").write.mode("append").parquet(source)
        run(spark.readStream.schema(schema).parquet(source))


@query(
    "audit_stream",
    O.with_(
        *O.AUDIT,
        "moved as (select * replace (case when cast(request_id as bigint) % 3 = 2 then created_at + interval 40 day"
        " else created_at end as created_at) from audit)",
    )
    + "select cast(created_at as date)::varchar as day, input_decision, count(*) as n,"
    " count(distinct request_id) as n_requests from moved group by all",
)
def audit_stream(spark, sf):
    """Rows appended once each although every one comes twice, on two days: in the same batch,
    where the earlier one counts, or two batches apart, where the first one to come does.
    """
    columns = ("request_id", "created_at", "input_decision", "input_redactions", "total_latency_ms")
    n = F.col("request_id").cast("int") % 3
    twice = F.explode(
        F.array(
            F.struct(n.alias("part"), F.lit(0).alias("days")),
            F.struct(F.when(n == 1, n).otherwise(2 - n).alias("part"), F.lit(40).alias("days")),
        )
    ).alias("copy")
    rows = D.audit(spark, sf).select(*columns, twice)
    rows = rows.withColumn("created_at", F.expr("created_at + make_interval(0, 0, 0, copy.days)"))
    path, checkpoint = shared_dir(spark, "audit-sink"), shared_dir(spark, "audit-checkpoint")
    rows = rows.select(*columns, "copy.part")
    in_batches(spark, rows, lambda stream: J.append_audit(stream, path, checkpoint))
    rows = J.read_appended(spark, path, rows.drop("part").schema)
    return rows.groupBy(F.col("dt").cast("string").alias("day"), "input_decision").agg(
        F.count("*").alias("n"), F.countDistinct("request_id").alias("n_requests")
    )


@query(
    "live_metrics",
    O.with_(
        *O.AUDIT,
        "w as (select time_bucket(interval 1 hour, created_at) as w, effective as decision, count(*) as n from audit group by all)",
    )
    + f"select strftime(w, {O.STAMP}) as window_start, decision, n from w",
)
def live_metrics(spark, sf):
    """All windows, those that are still open too."""
    path = shared_dir(spark, "metric-source")
    rows = D.audit(spark, sf).select("created_at", "input_decision", "output_decision")
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    found = J.latest_metrics(spark, J.run_live_metrics(J.live_metrics(stream, "1h", "10 minutes")))
    return found.select(stamp_col("window_start").alias("window_start"), "decision", "n")


@query(
    "late_metrics",
    O.with_(
        *O.AUDIT,
        "w as (select time_bucket(interval 1 hour, created_at) as w, effective as decision, created_at,"
        " cast(request_id as bigint) % 3 as part from audit)",
        "reached as (select a.part, max(b.m) as m from (select distinct part from w) a"
        " join (select part, max(created_at) as m from w group by part) b on b.part < a.part group by a.part)",
        "l as (select w.*, coalesce(w.w + interval 1 hour <= r.m - interval 7 day, false) as late"
        " from w left join reached r on r.part = w.part)",
    )
    + f"select strftime(w, {O.STAMP}) as window_start, decision, late, count(*) as n from l group by all",
)
def late_metrics(spark, sf):
    """Three batches over all times: rows a week behind the batches before go to the table of late ones."""
    rows = D.audit(spark, sf).select(
        "created_at", "input_decision", "output_decision", (F.col("request_id").cast("int") % 3).alias("part")
    )
    counts, rejects, checkpoint = (shared_dir(spark, n) for n in ("counts", "rejects", "counts-checkpoint"))
    in_batches(spark, rows, lambda stream: J.count_by_window(stream, counts, rejects, "1h", "7d", checkpoint))
    both = [J.window_counts(spark, p).withColumn("late", F.lit(late)) for p, late in ((counts, False), (rejects, True))]
    return both[0].unionByName(both[1]).select(
        stamp_col("window_start").alias("window_start"), "decision", "late", "n"
    )


_LIVE_HALVES = [
    O.DOCS,
    O.ENTITY_DIM,
    O.RULES,
    "rule2 as (select entity_type, case when entity_type = 'EMAIL' then 'BLOCK' else action end as action,"
    " min_confidence from rule)",
    O.raw("docs"),
    O.merged("raw"),
    O.actionable("merged", "acts1"),
    O.decided("docs", "acts1", "d1"),
    O.actionable("merged", "acts2", rule="rule2"),
    O.decided("docs", "acts2", "d2"),
]


def block_emails(spark):
    """A change of the rule on e-mail addresses."""
    seed = rules.default_rules(spark).filter("entity_type = 'EMAIL'").select("id")
    none = {c: F.lit(None) for c in ("name", "description", "entity_type", "min_confidence", "enabled")}
    return seed.withColumns({"op": F.lit("patch"), "action": F.lit("block"), **none}).select(
        "id", "op", *(F.col(c).cast(rules.RULE[c].dataType) for c in (*none, "action"))
    )


@query(
    "rule_versions",
    O.with_(*_LIVE_HALVES)
    + "select version, decision, count(*) as n, cast(1 as bigint) as refused, cast(2 as bigint) as newest from"
    " (select cast(1 as bigint) as version, decision from d1 union all select 2, decision from d2) group by all",
)
def rule_versions(spark, sf):
    """Scans under both versions of a rule table. A second writer that started from the first
    version is refused, and what it wanted to write is in neither.
    """
    store, as_of = shared_dir(spark, "rules"), F.lit("2024-02-01").cast("timestamp")
    first = rules.write_rule_version(rules.default_rules(spark), store)
    rules.commit_rules(spark, store, block_emails(spark), as_of, first)
    refused = 0
    try:
        rules.commit_rules(spark, store, block_emails(spark).withColumn("action", F.lit("allow")), as_of, first)
    except VersionConflict:
        refused += 1
    docs, newest = D.planted(spark, sf), newest_version(spark, store)
    scans = [
        scan(docs, rules.Policy(rules=rules.read_rule_version(spark, store, v)))
        .groupBy("decision").agg(F.count("*").alias("n")).withColumn("version", F.lit(v).cast("long"))
        for v in (1, newest)
    ]
    return scans[0].unionByName(scans[1]).withColumns(
        {"refused": F.lit(refused).cast("long"), "newest": F.lit(newest).cast("long")}
    )


@query(
    "live_rules",
    O.with_(*_LIVE_HALVES)
    + "select a.decision as before, b.decision as after, count(*) as n from d1 a join d2 b on b.k = a.k group by all",
)
def live_rules(spark, sf):
    """Every document comes in one batch and again in the next, and a rule is
    changed in between: the second batch is decided under the new rule.
    """
    source, sink, store, checkpoint = (
        shared_dir(spark, n) for n in ("texts", "live", "rules", "live-checkpoint")
    )
    docs = D.planted(spark, sf)
    for copy in ("before", "after"):
        if copy == "before":
            rules.write_rule_version(rules.default_rules(spark), store)
        else:
            rules.commit_rules(spark, store, block_emails(spark), F.lit("2024-02-01").cast("timestamp"))
        docs.withColumn("copy", F.lit(copy)).write.mode("append").parquet(source)
        J.scan_with_live_rules(
            spark.readStream.schema("doc_id bigint, text string, copy string").parquet(source),
            lambda session: rules.read_rule_version(session, store),
            sink,
            keep=("doc_id", "decision"),
            checkpoint=checkpoint,
        )
    rows = spark.read.schema("doc_id bigint, decision string, batch int").parquet(sink)
    first = rows.filter(F.col("batch") == 0).select("doc_id", F.col("decision").alias("before"))
    second = rows.filter(F.col("batch") == 1).select("doc_id", F.col("decision").alias("after"))
    return first.join(second, "doc_id").groupBy("before", "after").agg(F.count("*").alias("n"))


@query(
    "stream_equals_batch",
    O.with_(*O.SCAN)
    + "select d.decision, count(*) as n, cast(0 as bigint) as differing from decided d group by d.decision",
)
def stream_equals_batch(spark, sf):
    """The scan of a stream of documents against the batch scan."""
    source = shared_dir(spark, "docs")
    docs = D.planted(spark, sf)
    docs.write.parquet(source)
    files = max(2, spark.sparkContext.defaultParallelism)  # a batch keeps all cores busy
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files).parquet(source)
    keep = ["doc_id", "decision", "redacted_text", "redaction_counts"]
    path = J.run_to_parquet(scan(stream).select(*keep), "scan")
    flat = lambda df, n: df.select(
        "doc_id",
        F.col("decision"),
        F.sha2(F.concat_ws("|", "redacted_text", counts_text("redaction_counts")), 256).alias(n),
    )
    streamed = flat(spark.read.parquet(path), "a")
    batch = flat(scan(docs).select(*keep), "b").drop("decision")
    both = streamed.join(batch, "doc_id", "full_outer")
    return both.groupBy("decision").agg(
        F.count("*").alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing")
    )
