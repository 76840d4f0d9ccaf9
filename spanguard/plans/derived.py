"""Inputs of the registered queries, derived from the given tables.

The tables hold e-mail addresses, phone numbers and cards but none of the other
entities, so every text gets a suffix that depends on its key. `plant` is plain
SQL that DuckDB evaluates to the same string.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanguard.functions.spans import redact, redaction_counts
from spanguard.operators.requests import build_audit, evaluate_requests, scan_messages, scan_outputs
from spanguard.operators.scan import scan
from spanguard.schema import AUDIT, COUNTS, POLICY_ID
from spanguard.sources.tables import Texts, text_tasks

AS_OF = datetime(2024, 1, 31)
INPUT_PARTITIONS = "spanguard.inputPartitions"
NO_META = 13  # conversations of this remainder class have no event of their own
DETECT_SHARE, LLM_SHARE = 5, 2  # total / 5 is detection time, total / 2 the model's


def plant(key: str) -> str:
    k = f"cast({key} as string)"
    return f"""case ({key}) % 8
 when 1 then concat(' ssn ', cast(100 + ({key}) % 800 as string), '-45-', lpad(cast(({key}) % 10000 as string), 4, '0'))
 when 2 then concat(' key AKIA', upper(substr(md5({k}), 1, 16)), ' mail k', {k}, '@example.com')
 when 3 then concat(' token ghp_', md5({k}), substr(md5(concat('t', {k})), 1, 4), ' end')
 when 4 then concat(' jwt eyJ', md5({k}), '.eyJ', md5(concat('p', {k})), '.', md5(concat('s', {k})))
 when 5 then ' card 4111-1111-1111-1111 and 4111 1111 1111 1112'
 when 6 then concat(' mail user', {k}, '@example.com or call 555-867-5309')
 when 7 then ' write to 555-123-4567@corp.example.com'
 else '' end"""


_SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
    " value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Columns of the documents as they are stored. A caller who knows that the
    table is one file too small for the cores asks for `INPUT_PARTITIONS`.
    """
    docs, asked = table(spark, sf, "documents").select(*columns), spark.conf.get(INPUT_PARTITIONS, None)
    return docs.repartition(int(asked)) if asked else docs


def planted(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text) of all documents with their suffix."""
    docs = documents(spark, sf, "doc_id", "text")
    return docs.select("doc_id", F.expr(f"concat(text, {plant('doc_id')})").alias("text"))


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    return scan(planted(spark, sf))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Input messages (request_id, idx, role, content): every turn that is not
    the assistant's.
    """
    return (
        table(spark, sf, "conversations")
        .filter(F.col("role") != "assistant")
        .select(
            F.col("conv_id").cast("string").alias("request_id"),
            F.col("turn").cast("int").alias("idx"),
            "role",
            F.expr(f"concat(text, {plant('conv_id + turn')})").alias("content"),
        )
    )


def choices(spark: SparkSession, sf: str) -> DataFrame:
    """Response choices (request_id, idx, content): the assistant's turns."""
    return (
        table(spark, sf, "conversations")
        .filter(F.col("role") == "assistant")
        .select(
            F.col("conv_id").cast("string").alias("request_id"),
            F.col("turn").cast("int").alias("idx"),
            F.expr(f"concat(text, {plant('conv_id * 3 + turn')})").alias("content"),
        )
    )


def request_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Time, user, model and latencies of each request, from the event with the
    number of the conversation; one in `NO_META` has none.
    """
    return table(spark, sf, "events").filter(F.col("event_id") % NO_META != 5).select(
        F.col("event_id").cast("string").alias("request_id"), *_event_columns()
    )


def _event_columns():
    total = F.floor(F.col("value") * 10).cast("int")
    return [
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("model-"), "event_type").alias("model"),
        F.floor(total / DETECT_SHARE).cast("int").alias("detection_latency_ms"),
        F.floor(total / LLM_SHARE).cast("int").alias("llm_latency_ms"),
        total.alias("total_latency_ms"),
    ]


def conversation_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Audit rows built from whole conversations."""
    evaluated = evaluate_requests(scan_messages(messages(spark, sf)), "request_id")
    responses = scan_outputs(choices(spark, sf), "request_id")
    return build_audit(evaluated, responses, request_meta(spark, sf))


def document_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Per document the audit columns of a request that sends its text and is
    answered with one short line.
    """
    docs = documents(spark, sf, "doc_id", "text", "lang", "source").select(
        "doc_id",
        F.expr(f"concat(text, {plant('doc_id')})").alias("prompt"),
        F.expr(f"concat('on ', lang, ' ', source, {plant('doc_id + 3')})").alias("answer"),
    )
    hit, no_counts = F.col("input_decision") != "ALLOW", F.create_map().cast(COUNTS)
    given = scan(docs, text_col="prompt").select(
        "doc_id",
        "answer",
        F.col("decision").alias("input_decision"),
        "reasons",
        F.when(F.col("decision") != "ALLOW", redaction_counts("findings"))
        .otherwise(no_counts)
        .alias("input_redactions"),
        F.concat(
            F.lit("[user]: "),
            F.when(F.col("decision") != "ALLOW", redact("prompt", "findings")).otherwise(
                F.col("prompt")
            ),
        ).alias("prompt_redacted"),
    )
    answered = F.col("input_decision") != "BLOCK"
    return scan(given.withColumnRenamed("reasons", "in_reasons"), text_col="answer", is_output=True).select(
        "doc_id",
        "input_decision",
        F.when(answered, F.col("decision")).alias("output_decision"),
        F.col("in_reasons").alias("reasons"),
        "input_redactions",
        F.when(answered, F.col("redaction_counts")).otherwise(no_counts).alias("output_redactions"),
        "prompt_redacted",
        F.when(answered, F.col("redacted_text")).alias("response_redacted"),
    )


def audit_events(spark: SparkSession, sf: str) -> DataFrame:
    """The audit columns of every event, without those of its document: event n
    sends document n modulo their number.
    """
    docs = table(spark, sf, "documents")
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("request_id"),
        (F.col("event_id") % docs.select(F.count(F.lit(1))).scalar()).alias("doc_id"),
        *_event_columns(),
    )


def _audit_columns() -> list[Column]:
    """The audit table's columns, from those of an event and its document."""
    answered = F.col("input_decision") != "BLOCK"
    made = {
        "id": F.md5(F.concat(F.lit("audit|"), "request_id")),
        "policy_id": F.lit(POLICY_ID),
        "prompt_hash": F.sha2("prompt_redacted", 256),
        "llm_latency_ms": F.when(answered, F.col("llm_latency_ms")),
    }
    return [made.get(c, F.col(c)).alias(c) for c in AUDIT.fieldNames()]


def audit(spark: SparkSession, sf: str) -> DataFrame:
    """One audit row per event."""
    return audit_events(spark, sf).join(document_sides(spark, sf), "doc_id").select(_audit_columns())


def audit_texts(spark: SparkSession, sf: str) -> Texts:
    """What `write_audit` needs to make `audit` of `audit_events`."""
    n_bytes, zero = F.octet_length("text"), F.lit(0)
    size = documents(spark, sf, "text").agg(
        F.coalesce(F.sum(n_bytes), zero).alias("all"), F.coalesce(F.avg(n_bytes), zero).alias("mean")
    ).first()
    tasks = text_tasks(spark, size["all"], size["mean"] * table(spark, sf, "events").count())
    return Texts(document_sides(spark, sf), "doc_id", _audit_columns(), tasks)


def audit_findings(spark: SparkSession, sf: str, column: str = "findings") -> DataFrame:
    """Findings of every event's document in long form, with the event's time
    and the decision on the document.
    """
    docs = table(spark, sf, "documents")
    events = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("request_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        (F.col("event_id") % docs.select(F.count(F.lit(1))).scalar()).alias("doc_id"),
    )
    found = scanned(spark, sf).select(
        "doc_id", F.col("decision").alias("input_decision"), F.explode_outer(column).alias("f")
    )
    found = found.filter(F.col("f.entity_type").isNotNull()).select(
        "doc_id", "input_decision", "f.entity_type", "f.confidence", "f.detector"
    )
    return events.join(found, "doc_id").drop("doc_id")
