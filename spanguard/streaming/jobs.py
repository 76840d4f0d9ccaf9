"""Streaming jobs over audit rows and texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanguard.functions.policy import effective_decision
from spanguard.functions.stats import parse_duration
from spanguard.operators.metrics import window_start
from spanguard.operators.rules import Policy
from spanguard.operators.scan import scan
from spanguard.session import shared_dir
from spanguard.sources.tables import lookup_options
from spanguard.sources.versions import BatchTable


def run_to_parquet(
    df: DataFrame,
    name: str,
    partition_by: tuple[str, ...] = (),
    path: str | None = None,
    checkpoint: str | None = None,
    trigger: dict | None = None,
) -> str:
    """Append a stream to a Parquet table; its path.

    With the `path` and `checkpoint` of an earlier run it goes on where that
    ended; by default both are new, in the shared folder. It ends when the source
    is drained unless `trigger` says otherwise (`{"processingTime": "1 minute"}`).
    """
    spark = df.sparkSession
    path = path or shared_dir(spark, name)
    writer = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint or shared_dir(spark, f"{name}-checkpoint"))
        .trigger(**(trigger or {"availableNow": True}))
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start().awaitTermination()
    return path


def _by_batch(
    df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str, trigger: dict | None
) -> None:
    """Hand every micro-batch to `write`, which must replace what it wrote before."""
    (
        df.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
        .awaitTermination()
    )


#: Hash buckets of the index of request ids.
ID_BUCKETS = 64
_IDS = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("bucket", T.IntegerType())])


def _id_index(spark: SparkSession, path: str) -> BatchTable:
    return BatchTable(spark, f"{path}/_ids", _IDS, partition_by=("bucket",))


def append_audit(
    audit: DataFrame, path: str | None = None, checkpoint: str | None = None, trigger: dict | None = None
) -> str:
    """Append a stream of audit rows to a table, one row per request id; its path.

    A request id is there once in the whole table, whatever day its rows are of: the
    first one to come counts, within a micro-batch the earliest (ties: by content).
    Beside the table there is an index of its ids in hash buckets; a micro-batch looks
    only into the buckets of its own ids and reads no row of the table. There is no
    watermark, so no row is too late. A batch writes folders of its own, table before
    index, which a repeat of the batch replaces. Pass `path` and `checkpoint` of an earlier
    run to go on; an index that is missing is made from the table.
    """
    spark, schema = audit.sparkSession, audit.schema
    path = path or shared_dir(spark, "audit-sink")
    bucket = F.pmod(F.xxhash64(F.col("request_id").cast("string")), F.lit(ID_BUCKETS)).cast("int").alias("bucket")

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        index = _id_index(session, path)
        if batch_id > 0 and not index.exists():
            there = read_appended(session, path, schema).filter(F.col("batch") < batch_id)
            index.write(there.select(F.col("request_id").cast("string").alias("request_id"), bucket), batch_id - 1)
        row = F.struct(*batch.columns)
        first = F.min_by(row, F.struct("created_at", F.to_json(row))).alias("row")
        rows = batch.groupBy("request_id").agg(first).select("row.*").withColumn("bucket", bucket).persist()
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # ID_BUCKETS at most
        known = index.read(batch_id).filter(F.col("bucket").isin(touched)).select(F.col("request_id").alias("known"))
        fresh = rows.join(known, F.col("request_id").cast("string").eqNullSafe(F.col("known")), "left_anti")
        fresh = fresh.drop("bucket").withColumn("dt", F.to_date("created_at"))
        options = lookup_options("request_id")
        fresh.write.mode("overwrite").options(**options).partitionBy("dt").parquet(f"{path}/batch={batch_id}")
        rows.unpersist()
        written = read_appended(session, path, schema).filter(F.col("batch") == batch_id)
        ids = written.select(F.col("request_id").cast("string").alias("request_id"), bucket)
        index.write(ids.repartition("bucket"), batch_id)

    _by_batch(audit, write, checkpoint or shared_dir(spark, "audit-checkpoint"), "append", trigger)
    return path


def read_appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of `append_audit` with their `batch` and `dt`."""
    parts = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("dt", T.DateType())])
    return spark.read.schema(parts).parquet(path)


def live_metrics(audit: DataFrame, window: str = "5m", watermark: str = "10 minutes") -> DataFrame:
    """Requests per tumbling window and effective decision. The watermark bounds
    the windows in memory; rows later than that are dropped.
    """
    return (
        audit.withWatermark("created_at", watermark)
        .withColumn("decision", effective_decision())
        .groupBy(F.window("created_at", _seconds(window)).alias("w"), "decision")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "decision", "n")
    )


_COUNTS = T.StructType(
    [
        T.StructField("window_start", T.TimestampType()),
        T.StructField("decision", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("batch", T.LongType()),
    ]
)


def _newest_counts(rows: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("n", "batch"), "batch").alias("r")
    return rows.groupBy("window_start", "decision").agg(newest).select("window_start", "decision", "r.n", "r.batch")


def _summed_counts(rows: DataFrame) -> DataFrame:
    sums = F.sum("n").alias("n"), F.max("batch").alias("batch")
    return rows.groupBy("window_start", "decision").agg(*sums)


def run_live_metrics(
    metrics: DataFrame, path: str | None = None, checkpoint: str | None = None, trigger: dict | None = None
) -> str:
    """Keep the counts of `live_metrics` up to date in a table, open windows too; its path.

    Batches are merged into a snapshot of the newest counts every so often, so the number
    of folders stays bounded.
    """
    spark = metrics.sparkSession
    path = path or shared_dir(spark, "live-metrics")

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.withColumn("batch", F.lit(batch_id).cast("long"))
        BatchTable(batch.sparkSession, path, _COUNTS, _newest_counts).write(counts, batch_id)

    _by_batch(metrics, write, checkpoint or shared_dir(spark, "metrics-checkpoint"), "update", trigger)
    return path


def latest_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The newest count of every window and decision."""
    return _newest_counts(BatchTable(spark, path, _COUNTS).read()).drop("batch")


def count_by_window(
    audit: DataFrame,
    path: str,
    rejects: str,
    window: str = "5m",
    watermark: str = "10m",
    checkpoint: str | None = None,
    trigger: dict | None = None,
) -> None:
    """Requests per window and effective decision in the table `path`, those that came too
    late in `rejects`; both are read by `window_counts`.

    A row is too late if its window ended `watermark` or more before the latest row of the
    batches before. Nothing is kept in memory between batches: a batch adds its counts, and
    a row without a decision marks how far the time has come.
    """
    size, delay = parse_duration(window), parse_duration(watermark)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        counts, late = (BatchTable(session, p, _COUNTS, _summed_counts) for p in (path, rejects))
        reached = counts.read(batch_id).agg(F.max(F.when(F.col("decision").isNull(), F.col("window_start")))).first()[0]
        start = window_start("created_at", window)
        rows = batch.withColumn("decision", effective_decision()).withColumn("window_start", start)
        ended = F.lit(False) if reached is None else F.col("window_start") + F.lit(size) <= F.lit(reached - delay)
        found = rows.groupBy("window_start", "decision", ended.alias("late")).agg(
            F.count("*").alias("n"), F.max("created_at").alias("at")
        ).withColumn("batch", F.lit(batch_id).cast("long")).persist()
        mark = found.agg(F.max("at").alias("window_start")).filter("window_start is not null")
        mark = mark.selectExpr("window_start", "cast(null as string) decision", "0L n", f"{batch_id}L batch")
        names = _COUNTS.fieldNames()
        late.write(found.filter("late").select(names), batch_id)
        counts.write(found.filter("not late").select(names).unionByName(mark), batch_id)
        found.unpersist()

    spark = audit.sparkSession
    _by_batch(audit, write, checkpoint or shared_dir(spark, "counts-checkpoint"), "append", trigger)


def window_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts of one of the tables of `count_by_window`."""
    rows = BatchTable(spark, path, _COUNTS).read().filter("decision is not null")
    return _summed_counts(rows).drop("batch")


def _seconds(window: str) -> str:
    return f"{int(parse_duration(window).total_seconds())} seconds"


def scan_with_live_rules(
    texts: DataFrame,
    load_rules: Callable[[SparkSession], DataFrame],
    path: str,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id", "decision", "redacted_text"),
    checkpoint: str | None = None,
    trigger: dict | None = None,
) -> None:
    """Scan a stream under rules read anew for every micro-batch, so a rule
    change is seen by the next batch. `rules.read_rule_version` reads the newest version
    of a versioned rule table. With a `trigger` such as `{"processingTime": "10 seconds"}`
    it goes on until it is stopped; by default it ends when the source is drained.

    A batch that is repeated after a failure overwrites its own folder. Pass
    the `checkpoint` of an earlier run to go on where it ended.
    """
    checkpoint = checkpoint or shared_dir(texts.sparkSession, "rules-checkpoint")

    def batch(df: DataFrame, batch_id: int) -> None:
        policy = Policy(rules=load_rules(df.sparkSession))
        out = scan(df, policy, text_col).select(*keep)
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _by_batch(texts, batch, checkpoint, "append", trigger)


def failures_by_cause(failed: DataFrame, window: str, ts: str = "ts") -> DataFrame:
    """Failed responses per window and error type, with its message."""
    cause = ("error_type", "message")
    return failed.groupBy(window_start(ts, window).alias("window_start"), *cause).agg(
        F.count(F.lit(1)).alias("n")
    )
