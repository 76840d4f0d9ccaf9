"""What the operators of this package share: row numbers, stored tables, byte columns.

Every operator takes the names of its id and text columns and selects only these,
so further columns of any name never clash with its own. A table handed in should
be a stored one: it is scanned more than once, and a row's number has to be the
same each time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanguard.session import shared_dir

#: Name of the column with a row's number.
ROW = "row_no"
#: Bytes of a column that are held as Python objects at a time.
PACKED = 1 << 18


def row_number(row_col: str | None) -> Column:
    """The caller's unique row number, or one from file split and position."""
    return (F.monotonically_increasing_id() if row_col is None else F.col(row_col)).alias(ROW)


def id_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` below the shared folder and read it back, which cuts its lineage.

    A lost executor costs only its running tasks: the files are on storage that
    all executors share.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose bytes in `column` stay near `limit`."""
    for batch in batches:
        start = size = 0
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        for i, n in enumerate(lengths):
            size += n or 0
            if size >= limit:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the last column, a text, by its compressed bytes: less to shuffle."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data = [press.compress(b) for b in as_bytes(batch.column(batch.num_columns - 1))]
        columns = batch.columns[:-1] + [pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1] + ["packed"])


def in_steps(column: pa.Array, kind: pa.DataType, step: Callable[[pa.Array], list]) -> pa.Array:
    """What `step` makes of the column, of some `PACKED` bytes at a time: as Python objects they take more room."""
    batch = pa.RecordBatch.from_arrays([column], ["c"])
    parts = [pa.array(step(part.column(0)), kind) for part in slices([batch], 0, PACKED)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(returnType=T.BinaryType())
def packed_text(texts: pa.Array) -> pa.Array:
    """A text column compressed as by `pack`, for rows that keep their other columns; null stays null."""
    press = zstandard.ZstdCompressor(level=1).compress
    return in_steps(
        texts, pa.binary(), lambda part: [None if b is None else press(b) for b in part.cast(pa.large_binary()).to_pylist()]
    )


@F.arrow_udf(returnType=T.StringType())
def unpacked_text(frames: pa.Array) -> pa.Array:
    open_ = zstandard.ZstdDecompressor().decompress
    return in_steps(frames, pa.string(), lambda part: [None if b is None else open_(b).decode() for b in part.to_pylist()])
