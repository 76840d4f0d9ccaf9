"""Chat requests: one row per message in, one audit row per request out.

Messages stay in long form while they are scanned. Per request the decision and
the counts are plain aggregates; only the prompt and the reasons have to bring
the messages of a request together, and that happens in two steps: blocks of
consecutive messages first, then the few blocks of a request.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanguard.functions.policy import action_of, max_severity
from spanguard.functions.spans import redact, redaction_counts
from spanguard.operators.models import Detector
from spanguard.operators.rules import Policy
from spanguard.operators.scan import active_detectors, scan
from spanguard.schema import AUDIT, COUNTS, ENTITY_TYPES
from spanguard.session import shared_dir

BLOCK = 256  # messages joined per first-level group


def scannable_messages(requests: DataFrame, *keys: str) -> DataFrame:
    """One row per message with content, of every role, with its index."""
    return (
        requests.select(*keys, F.posexplode("messages").alias("idx", "m"))
        .filter(F.length("m.content") > 0)
        .select(*keys, "idx", "m.role", "m.content")
    )


def user_of(user: str = "user", header: str = "x_user_id") -> Column:
    """Body user, else header user, else anonymous; an empty one counts as none."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(blank(user), blank(header), F.lit("anonymous"))


def ordered_blocks(df: DataFrame, keys: Sequence[str], order: str, aggs, again) -> DataFrame:
    """Two-step grouping by `keys`: `aggs(order)` per block of consecutive
    `order` values, then `again('_block')` over the blocks. A request of any
    length is spread over many first-level groups.
    """
    block = F.floor(F.col(order) / BLOCK).alias("_block")
    first = df.withColumn("_block", block).groupBy(*keys, "_block").agg(*aggs)
    return first.groupBy(*keys).agg(*again)


def _joined(order: str, text: Column, sep: str = "\n") -> Column:
    """Texts of a group in `order`, joined."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), sep, "")


def _flat(order: str, items: Column) -> Column:
    """Arrays of a group in `order`, flattened."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), items.alias("t"))))
    return F.flatten(F.transform(rows, lambda r: r["t"]))


def assemble_prompt(messages: DataFrame, *keys: str) -> DataFrame:
    """`prompt`: "[role]: content" of every message of a request, one per line
    in order; null content is an empty string.
    """
    line = F.concat(
        F.lit("["), "role", F.lit("]: "), F.coalesce(F.col("content"), F.lit(""))
    )
    return ordered_blocks(
        messages,
        keys,
        "idx",
        [_joined("idx", line).alias("_text")],
        [_joined("_block", F.col("_text")).alias("prompt")],
    )


def _latest(entity_type: str, order: str, counts: str) -> Column:
    count = F.try_element_at(F.col(counts), F.lit(entity_type))
    return F.max(
        F.when(count.isNotNull(), F.struct(F.col(order).alias("o"), count.alias("n")))
    )


def _to_counts(values: dict[str, Column]) -> Column:
    """Map of the non-null counts, in the order of their keys."""
    entries = [
        F.when(n.isNotNull(), F.struct(F.lit(t).alias("key"), n.cast("long").alias("value")))
        for t, n in sorted(values.items())
    ]
    return F.map_from_entries(F.array_compact(F.array(*entries))).cast(COUNTS)


def request_counts(messages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Redactions per request from the `counts` of its messages:
    `input_redactions`, where the last message that names a type wins, and
    `summed`, where they add up.
    """
    last = {t: _latest(t, "idx", "counts").alias(f"_{t}") for t in ENTITY_TYPES}
    total = {
        t: F.sum(F.try_element_at(F.col("counts"), F.lit(t))).alias(f"_sum_{t}") for t in ENTITY_TYPES
    }
    wide = messages.groupBy(*keys).agg(*last.values(), *total.values())
    return wide.select(
        *keys,
        _to_counts({t: F.col(f"_{t}.n") for t in ENTITY_TYPES}).alias("input_redactions"),
        _to_counts({t: F.col(f"_sum_{t}") for t in ENTITY_TYPES}).alias("summed"),
    )


def scan_messages(
    messages: DataFrame,
    policy: Policy | None = None,
    detectors: Sequence[Detector] = (),
) -> DataFrame:
    """Scan of each message plus `redacted` and `counts` over **all** its
    findings, which apply if the request as a whole is masked or blocked.
    """
    policy = policy or Policy()
    return (
        scan(messages, policy, "content", detectors=detectors)
        .withColumn("severity", max_severity("actionable"))
        .withColumn("_content", F.col("content"))
        .withColumn("redacted", F.when(F.size("findings") > 0, redact("_content", "findings")))
        .withColumn("counts", redaction_counts("findings"))
        .drop("_content", "decision", "redacted_text", "redaction_counts")
    )


def request_decisions(scanned: DataFrame, *keys: str) -> DataFrame:
    """Decision over the union of the findings of a request."""
    return scanned.groupBy(*keys).agg(
        action_of("max(severity)").alias("input_decision"),
        F.sum(F.size("findings")).alias("n_findings"),
        F.sum(F.size("actionable")).alias("n_actionable"),
    )


def redact_messages(scanned: DataFrame, *keys: str) -> DataFrame:
    """Messages as they may be forwarded: with all findings redacted once their
    request is not ALLOW, untouched otherwise.

    The scan runs once: its messages are stored in the shared folder, then the
    requests that are masked or blocked are joined to them. AQE splits the
    partition of a request with very many messages.
    """
    kept = scanned.select(*keys, "idx", "role", "content", "redacted", "severity")
    path = shared_dir(scanned.sparkSession, "scanned-messages")
    kept.write.parquet(path)
    kept = scanned.sparkSession.read.schema(kept.schema).parquet(path)
    hit = kept.filter("severity > 1").select(*keys, F.lit(True).alias("_hit")).distinct()
    return (
        kept.join(hit, list(keys), "left")
        .withColumn(
            "content",
            F.when(
                F.col("_hit").isNotNull(), F.coalesce("redacted", "content")
            ).otherwise(F.col("content")),
        )
        .select(*keys, "idx", "role", "content")
    )


def evaluate_requests(scanned: DataFrame, *keys: str) -> DataFrame:
    """Everything an audit row needs of the input side: decision, reasons,
    counts (last message wins) and the redacted prompt.
    """
    head = F.concat(F.lit("["), "role", F.lit("]: "))
    raw = F.concat(head, F.coalesce(F.col("content"), F.lit("")))
    # Null while no message of the block has findings: the raw text is the same.
    red_line = F.concat(head, F.coalesce("redacted", "content", F.lit("")))
    has = F.max(F.col("redacted").isNotNull())
    first = [
        F.max("severity").alias("_severity"),
        F.sum(F.size("findings")).alias("_findings"),
        _joined("idx", raw).alias("_raw"),
        F.when(has, _joined("idx", red_line)).alias("_red"),
        _flat("idx", F.col("reasons")).alias("_reasons"),
        *[_latest(t, "idx", "counts").alias(f"_{t}") for t in ENTITY_TYPES],
    ]
    again = [
        F.max("_severity").alias("severity"),
        F.sum("_findings").alias("n_findings"),
        _joined("_block", F.col("_raw")).alias("_raw"),
        _joined("_block", F.coalesce("_red", "_raw")).alias("_red"),
        _flat("_block", F.col("_reasons")).alias("reasons"),
        *[F.max(f"_{t}").alias(f"_{t}") for t in ENTITY_TYPES],
    ]
    hit = F.col("severity") > 1
    counts = _to_counts({t: F.col(f"_{t}.n") for t in ENTITY_TYPES})
    return (
        ordered_blocks(scanned, keys, "idx", first, again)
        .withColumn("input_decision", action_of("severity"))
        .withColumn("prompt_redacted", F.when(hit, F.col("_red")).otherwise(F.col("_raw")))
        .withColumn(
            "input_redactions",
            F.when(hit, counts).otherwise(F.create_map().cast(COUNTS)),
        )
        .select(
            *keys,
            "input_decision",
            "reasons",
            "input_redactions",
            "prompt_redacted",
            "n_findings",
        )
    )


def scan_outputs(
    choices: DataFrame,
    *keys: str,
    policy: Policy | None = None,
    detectors: Sequence[Detector] = (),
) -> DataFrame:
    """Responses per request from long (keys, idx, content): choices redacted on
    their own, counts summed, decision of the last choice that was not ALLOW.
    """
    scanned = scan(choices, policy, "content", is_output=True, detectors=detectors)
    hit = F.col("decision") != "ALLOW"
    last = F.max(F.when(hit, F.struct(F.col("idx").alias("o"), F.col("decision").alias("d"))))
    total = lambda t: F.sum(F.try_element_at(F.col("redaction_counts"), F.lit(t)))
    first = [
        last.alias("_last"),
        _joined("idx", F.coalesce("redacted_text", F.lit(""))).alias("_text"),
        *[total(t).alias(f"_{t}") for t in ENTITY_TYPES],
    ]
    again = [
        F.max("_last").alias("_last"),
        _joined("_block", F.col("_text")).alias("response_redacted"),
        *[F.sum(f"_{t}").alias(f"_{t}") for t in ENTITY_TYPES],
    ]
    counts = _to_counts({t: F.col(f"_{t}") for t in ENTITY_TYPES})
    return ordered_blocks(scanned, keys, "idx", first, again).select(
        *keys,
        F.coalesce(F.col("_last.d"), F.lit("ALLOW")).alias("output_decision"),
        counts.alias("output_redactions"),
        "response_redacted",
    )


def build_audit(
    evaluated: DataFrame,
    responses: DataFrame,
    meta: DataFrame,
    policy: Policy | None = None,
) -> DataFrame:
    """Audit rows (`schema.AUDIT`). `meta` has one row per request: request_id,
    created_at, user_id, model and the three latencies; a request without one
    still gets its row, with nulls. A blocked request has no output side.
    """
    policy = policy or Policy()
    blocked = F.col("input_decision") == "BLOCK"
    unless_blocked = lambda c: F.when(~blocked, F.col(c))
    rows = (
        evaluated.join(meta, "request_id", "left")
        .join(responses, "request_id", "left")
        .select(
            F.md5(F.concat(F.lit("audit|"), "request_id")).alias("id"),
            "request_id",
            "created_at",
            "user_id",
            "model",
            "input_decision",
            F.when(~blocked, F.coalesce("output_decision", F.lit("ALLOW"))).alias(
                "output_decision"
            ),
            F.lit(policy.policy_id).alias("policy_id"),
            "reasons",
            "input_redactions",
            F.coalesce(
                unless_blocked("output_redactions"), F.create_map().cast(COUNTS)
            ).alias("output_redactions"),
            "prompt_redacted",
            unless_blocked("response_redacted").alias("response_redacted"),
            F.sha2("prompt_redacted", 256).alias("prompt_hash"),
            "detection_latency_ms",
            unless_blocked("llm_latency_ms").alias("llm_latency_ms"),
            "total_latency_ms",
        )
    )
    return rows.select(AUDIT.fieldNames())


def decision_metadata(audit: DataFrame, detectors: Sequence[Detector] = ()) -> DataFrame:
    """The metadata block a response carries, as a struct and as JSON."""
    block = F.struct(
        "request_id",
        "input_decision",
        "output_decision",
        "input_redactions",
        "output_redactions",
        "policy_id",
        active_detectors(detectors).alias("detectors_used"),
        F.create_map(
            F.lit("detection"),
            F.col("detection_latency_ms"),
            F.lit("llm"),
            F.col("llm_latency_ms"),
            F.lit("total"),
            F.col("total_latency_ms"),
        ).alias("latency_ms"),
    )
    return audit.select(
        "request_id",
        block.alias("ppg"),
        F.to_json(block, {"ignoreNullFields": "false"}).alias("ppg_json"),
    )
