"""Streamed responses: parse event lines, assemble, scan, emit again."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanguard.operators.requests import _joined, ordered_blocks
from spanguard.operators.rules import Policy
from spanguard.operators.scan import active_detectors, scan
from spanguard.schema import CHUNK

PREFIX = "data: "


def read_sse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds `kind` (chunk, done or skip) and, for chunks, `payload`, `content`
    and `finish_reason` of the first choice. Lines without the prefix and
    malformed JSON are skipped; a chunk without choices is kept.
    """
    payload = F.trim(F.expr(f"substring({line}, {len(PREFIX) + 1})"))
    schema = CHUNK.simpleString()[:-1] + ",_corrupt_record:string>"
    first = F.get(F.col("_c.choices"), F.lit(0))
    is_chunk = F.col("kind") == "chunk"
    return (
        lines.withColumn("payload", F.when(F.col(line).startswith(PREFIX), payload))
        .withColumn(
            "_c",
            F.from_json(
                "payload",
                schema,
                {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
            ),
        )
        .withColumn(
            "kind",
            F.when(F.col("payload") == "[DONE]", "done")
            .when(
                F.col("payload").isNotNull() & F.col("_c._corrupt_record").isNull(), "chunk"
            )
            .otherwise("skip"),
        )
        .withColumn("payload", F.when(is_chunk, F.col("payload")))
        .withColumn("content", F.when(is_chunk, first["delta"]["content"]))
        .withColumn("finish_reason", F.when(is_chunk, first["finish_reason"]))
        .drop("_c")
    )


_ASSEMBLED = (
    "request_id string, content string, finish_reason string, chunks array<string>,"
    " status string"
)
_LINE_FIELDS = ("kind", "payload", "content", "finish_reason")
_LINE = "seq bigint, " + ", ".join(f"{c} string" for c in _LINE_FIELDS)
# Line numbers so far as ranges (first, behind the last, first, …), the number of the [DONE]
# line, whether the response has been emitted, and the timer that is set.
_MARK = "ranges array<bigint>, done bigint, closed boolean, timer bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def add_to_ranges(ranges: list[int], numbers: list[int]) -> tuple[list[int], set[int]]:
    """Ranges of line numbers with `numbers` added, and which of these are new."""
    new = {n for n in numbers if bisect_right(ranges, n) % 2 == 0}
    edges = sorted([*zip(ranges[::2], ranges[1::2]), *((n, n + 1) for n in new)])
    out: list[int] = []
    for low, high in edges:
        if out and out[-1] == low:
            out[-1] = high
        else:
            out += [low, high]
    return out, new


class Assembler(StatefulProcessor):
    """Keeps the lines of open responses, one state value per batch's new line.

    A batch appends its lines to a list and rewrites only the small mark; the lines of
    earlier batches are read when the response ends, and at no other time.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", _MARK)
        self.lines = handle.getListState("lines", _LINE)

    def response(self, key: tuple, done: int | None, status: str) -> Row:
        rows = sorted(((r[0], *r[1:]) for r in self.lines.get()), key=lambda r: r[0])
        chunks = [r for r in rows if r[1] == "chunk" and (done is None or r[0] < done)]
        reasons = [r[4] for r in chunks if r[4]]
        return Row(
            request_id=key[0],
            content="".join(r[3] or "" for r in chunks),
            finish_reason=reasons[-1] if reasons else None,
            chunks=[r[2] for r in chunks],
            status=status,
        )

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        ranges, done, closed, timer = self.mark.get() if self.mark.exists() else ([], None, False, None)
        latest, lines = timerValues.getCurrentWatermarkInMs(), {}
        for r in rows:
            latest = max(latest, r["_ms"])
            lines.setdefault(r["seq"], (r["seq"], r["kind"], r["payload"], r["content"], r["finish_reason"]))
        if not closed:
            ranges, new = add_to_ranges(list(ranges), list(lines))
            if new:
                self.lines.appendList([lines[n] for n in sorted(new)])
            ends = [n for n in new if lines[n][1] == "done"]
            done = min([*ends, *([done] if done is not None else [])], default=None)
            if done is not None and (done == 0 or ranges[:1] == [0] and ranges[1] >= done):
                yield self.response(key, done, "done")
                self.lines.clear()
                ranges, closed = [], True
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = latest + self.timeout_ms
        self.handle.registerTimer(timer)
        self.mark.update((ranges, done, closed, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        if self.mark.exists():
            _, done, closed, _ = self.mark.get()
            if not closed:
                yield self.response(key, done, "abandoned")
        self.lines.clear()
        self.mark.clear()

    def close(self) -> None:
        pass


def assemble_stream(
    parsed: DataFrame, ts: str = "ts", watermark: str = "10 minutes", timeout_ms: int = 600_000
) -> DataFrame:
    """Whole responses from (request_id, seq, ts, ...) rows of `read_sse_lines`.

    A response is emitted once its [DONE] line and all lines before it have
    arrived, in whatever order and over however many batches. Of lines with one number
    the first one counts. Lines after [DONE] are ignored, in later batches too: an emitted
    response leaves a mark behind until `timeout_ms` of event time have passed. One that
    stays incomplete so long is emitted with status `abandoned` and what there is of it.

    State is kept by Spark's RocksDB provider, which this sets for the session: lines live on
    disk, and a checkpoint holds the changes of a batch only.
    """
    parsed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return (
        parsed.withWatermark(ts, watermark)
        .select("request_id", "seq", ts, F.unix_millis(ts).alias("_ms"), *_LINE_FIELDS)
        .groupBy("request_id")
        .transformWithState(Assembler(timeout_ms), _ASSEMBLED, "append", "EventTime")
    )


def assemble_batch(parsed: DataFrame) -> DataFrame:
    """The same over a finished table of lines, with built-in aggregates only:
    responses with a [DONE] line, from the lines before it.
    """
    done = (
        parsed.filter(F.col("kind") == "done")
        .groupBy("request_id")
        .agg(F.min("seq").alias("_done"))
    )
    chunks = parsed.filter(F.col("kind") == "chunk").join(done, "request_id")
    chunks = chunks.filter(F.col("seq") < F.col("_done"))
    reason = F.max(
        F.when(
            F.col("finish_reason").isNotNull(),
            F.struct(F.col("seq").alias("o"), F.col("finish_reason").alias("r")),
        )
    )
    return ordered_blocks(
        chunks,
        ["request_id"],
        "seq",
        [
            _joined("seq", F.coalesce("content", F.lit("")), "").alias("_text"),
            reason.alias("_reason"),
            F.count(F.lit(1)).alias("_n"),
        ],
        [
            _joined("_block", F.col("_text"), "").alias("content"),
            F.max("_reason").alias("_reason"),
            F.sum("_n").alias("n_chunks"),
        ],
    ).select("request_id", "content", F.col("_reason.r").alias("finish_reason"), "n_chunks")


def scan_stream(
    responses: DataFrame, policy: Policy | None = None, text_col: str = "content"
) -> DataFrame:
    """Output scan of whole responses; stateless, so it runs on a stream as is."""
    return scan(responses, policy, text_col, is_output=True)


def reemit(scanned: DataFrame, meta: str) -> DataFrame:
    """Event lines of scanned responses (request_id, seq, line): two fresh
    chunks if the text was redacted, the original ones otherwise, the JSON in
    column `meta` as `ppg` on the last chunk, then [DONE].
    """
    parsed = F.from_json(F.get("chunks", F.lit(0)), CHUNK.simpleString())
    redacted = F.col("redacted_text") != F.col("content")
    base = lambda choices: F.struct(
        F.coalesce("_f.id", F.concat(F.lit("chatcmpl-"), "request_id")).alias("id"),
        F.lit("chat.completion.chunk").alias("object"),
        F.col("_f.created").alias("created"),
        F.col("_f.model").alias("model"),
        F.array(choices).alias("choices"),
    )
    content_choice = F.struct(
        F.lit(0).alias("index"),
        F.struct(F.col("redacted_text").alias("content")).alias("delta"),
        F.lit(None).cast("string").alias("finish_reason"),
    )
    done_choice = F.struct(
        F.lit(0).alias("index"),
        F.create_map().cast("map<string,string>").alias("delta"),
        F.coalesce("finish_reason", F.lit("stop")).alias("finish_reason"),
    )
    as_json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    fresh = F.array(as_json(base(content_choice)), as_json(base(done_choice)))
    last = F.element_at("_out", -1)
    tagged = F.concat(
        last.substr(F.lit(1), F.length(last) - 1),
        F.when(last == "{}", "").otherwise(","),
        F.lit('"ppg":'),
        F.col(meta),
        F.lit("}"),
    )
    body = F.when(
        F.size("_out") > 0,
        F.concat(F.slice("_out", 1, F.size("_out") - 1), F.array(tagged)),
    ).otherwise(F.col("_out"))
    lines = F.concat(
        F.transform(body, lambda p: F.concat(F.lit(PREFIX), p)),
        F.array(F.lit(PREFIX + "[DONE]")),
    )
    return (
        scanned.withColumn("_f", parsed)
        .withColumn(
            "_out",
            F.when(redacted & (F.size("chunks") > 0), fresh).otherwise(F.col("chunks")),
        )
        .select("request_id", F.posexplode(lines).alias("seq", "line"))
    )


def stream_metadata(scanned: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Adds `ppg`, the JSON metadata of the output side of a response."""
    policy = policy or Policy()
    block = F.struct(
        "request_id",
        F.col("decision").alias("output_decision"),
        F.col("redaction_counts").alias("output_redactions"),
        F.lit(policy.policy_id).alias("policy_id"),
        active_detectors().alias("detectors_used"),
    )
    return scanned.withColumn("ppg", F.to_json(block, {"ignoreNullFields": "false"}))


# --- Fixed values: error records of a failed response -------------------------
FAILURES = [
    ("timeout", "timeout", "LLM backend timed out"),
    ("http_error", "backend_error", "LLM backend error"),
    ("connect_error", "connection_error", "Cannot connect to LLM backend"),
]


def failed_streams(responses: DataFrame, status: str = "status") -> DataFrame:
    """Error record of every failed response; failures leave no audit row."""
    kind, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for cause, error_type, text in FAILURES:
        hit = F.col(status) == cause
        kind = F.when(hit, error_type).otherwise(kind)
        message = F.when(hit, text).otherwise(message)
    failed = responses.filter(F.col(status).isin([c for c, _, _ in FAILURES]))
    return failed.withColumn("error_type", kind).withColumn("message", message)
