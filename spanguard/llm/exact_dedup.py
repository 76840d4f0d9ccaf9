"""Exact duplicates by distributed most-significant-digit radix partitioning.

A text's bytes are cut into digits. Round 0 splits all texts by their first digit;
each later round splits what shares all digits so far by the next one, which is
wider. A text leaves as soon as it is alone in its group or has ended, so bytes
behind the first difference are never compared, and equality needs no digest: two
texts in one group have had every byte in common.

A round counts its groups with partial aggregation and joins the counts back to
the rows. A group of any size is therefore never gathered in one task: its rows
meet one small row, and a skewed join splits them.

Digits after the first and what follows them travel as Zstandard frames. Equal
bytes give equal frames and a frame gives its bytes back, so comparing frames
compares bytes. All joins are sort-merge joins: what shares a digit grows with the
table, so it is never broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanguard.llm.common import ROW, as_bytes, id_type, row_number, slices, stored

#: Bytes of the first digit, and how much wider each next digit is.
FIRST_DIGIT = 64
GROWTH = 8
#: Bytes of text a task takes up at a time.
SLICE_BYTES = 8 << 20


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    first_digit: int = FIRST_DIGIT,
) -> DataFrame:
    """Each row with the row that stays of all rows with an equal text.

    Texts are equal if their UTF-8 bytes are after lower-casing A-Z; a null text
    counts as empty, and all empty texts are one group. Of a group the row with
    the largest id stays (null ids are smallest); of rows that share this id,
    repeated rows included, exactly one stays. Returns a row per input row:
    the id, keep_id, group_size, kept, text_sha256 and the row's number.
    An empty table gives an empty result.
    """
    kind = id_type(docs, id_col)
    rows = docs.select(row_number(row_col), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [b[:first_digit].lower() for b in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.binary())], ["digit"])

    def digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, 2, SLICE_BYTES):
            low = [b.lower() for b in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([hashlib.sha256(b).digest() for b in low], pa.binary()),
                    pa.array([b[:first_digit] for b in low], pa.binary()),
                    pa.array([frame(b[first_digit:]) for b in low], pa.binary()),
                ],
                [ROW, "id", "sha", "digit", "rest"],
            )

    # Counts are stored before they are joined: a join can split a hot group only if
    # its rows come straight from a shuffle on either side.
    shared = stored(
        rows.select("text").mapInArrow(heads, "digit binary")
        .groupBy("digit").agg(F.count("*").alias("n")).filter("n > 1").select("digit", F.lit(True).alias("shared")),
        "radix-shared",
    )
    first = rows.mapInArrow(digits, f"{ROW} long, id {kind}, sha binary, digit binary, rest binary")
    state = stored(
        first.join(shared.hint("merge"), "digit", "left").select(
            ROW, "id", "sha",
            F.when(F.col("shared"), F.col("digit")).alias("group"),
            F.when(F.col("shared"), F.col("rest")).alias("rest"),
        ),
        "radix-0",
    )
    alone = [F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")]
    done = state.filter("group is null").select(ROW, "id", "sha", *alone)
    live, width, level = state.filter("group is not null"), first_digit, 0
    while not live.isEmpty():
        width, level = width * GROWTH, level + 1
        key = ["group", "digit", "ended"]
        found = stored(
            next_digit(live.select(ROW, "id", "group", "rest"), width, remainder=False)
            .groupBy(*key)
            .agg(F.count("*").alias("n"), F.max(F.struct("id", ROW)).alias("top"), F.min(ROW).alias("next"))
            .filter("n > 1"),
            f"radix-{level}-groups",
        )
        split = next_digit(live, width).join(found.hint("merge"), key, "left")
        split = split.withColumn("over", F.col("ended") | F.col("n").isNull())
        state = stored(
            split.select(
                ROW, "id", "sha", "over",
                F.coalesce("n", F.lit(1).cast("long")).alias("n"),
                F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("keep_id"),
                F.coalesce(F.col("top")[ROW] == F.col(ROW), F.lit(True)).alias("kept"),
                F.when(~F.col("over"), F.col("next")).alias("group"),
                F.when(~F.col("over"), F.col("rest")).alias("rest"),
            ),
            f"radix-{level}",
        )
        done = done.unionByName(
            state.filter("over").select(ROW, "id", "sha", "keep_id", F.col("n").alias("group_size"), "kept")
        )
        live = state.filter("not over").select(ROW, "id", "sha", "group", "rest")
    return done.select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), ROW
    )


def next_digit(live: DataFrame, width: int, remainder: bool = True) -> DataFrame:
    """Rows with the frame of their next `width` bytes, and whether they end there.

    Takes the frame of all bytes left as the last column, `rest`. With `remainder`
    that of the bytes behind the digit takes its place, otherwise it is dropped.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, open_ = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, batch_end, SLICE_BYTES):
            left = [open_(b) for b in batch.column(batch_end).to_pylist()]
            columns = [*batch.columns[:-1], pa.array([frame(b[:width]) for b in left], pa.binary())]
            columns.append(pa.array([len(b) <= width for b in left], pa.bool_()))
            if remainder:
                columns.append(pa.array([frame(b[width:]) if len(b) > width else None for b in left], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    batch_end = len(live.columns) - 1
    kept = live.schema.fields[:-1]
    schema = T.StructType([*kept, T.StructField("digit", T.BinaryType()), T.StructField("ended", T.BooleanType())])
    if remainder:
        schema = schema.add("rest", T.BinaryType())
    names = schema.names
    return live.mapInArrow(cut, schema)
