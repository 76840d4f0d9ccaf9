"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole records,
with the seek table of the seekable format as its last, skippable frame. Any tool
that reads Zstandard can read it from the start; this one goes straight to a
frame. The manifest maps a record's identifier to its bundle, its frame and its
offset inside the decompressed frame.

Tasks write bundles of their own names, so a task that is run twice leaves a file
that no manifest row points to, and never a torn one.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanguard.llm.common import ROW, id_type, row_number, stored
from spanguard.session import shared_dir

# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER_BYTES = 9

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 28
#: Plain bytes of records that a reading task is given.
READ_BYTES = 1 << 24
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "record_id string, bundle string, frame int, offset long, length long"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class Bundle:
    """Writes records into frames, and the seek table at the end."""

    def __init__(self, folder: str, frame_bytes: int):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        fs, path = filesystem(self.uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = fs.open_output_stream(path, compression=None)
        self.pack, self.frame_bytes = zstandard.ZstdCompressor(level=3), frame_bytes
        self.frames: list[tuple[int, int]] = []
        self.open, self.size, self.total = [], 0, 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        place = len(self.frames), self.size, len(record)
        self.open.append(record)
        self.size += len(record)
        self.total += len(record)
        if self.size >= self.frame_bytes:
            self.flush()
        return place

    def flush(self) -> None:
        if self.open:
            packed = self.pack.compress(b"".join(self.open))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.open, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


def seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """Position, packed and plain size of each frame, from the footer."""
    end = file.size()
    n, _, magic = struct.unpack("<IBI", file.read_at(FOOTER_BYTES, end - FOOTER_BYTES))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the bundle has no seek table")
    raw, at, frames = file.read_at(8 * n, end - FOOTER_BYTES - 8 * n), 0, []
    for packed, plain in struct.iter_unpack("<II", raw):
        frames.append((at, packed, plain))
        at += packed
    return frames


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    head.append(f"X-Payload-Length: {len(payload)}")
    body = HTTP_HEAD
    if refers_to is None:
        head.append("WARC-Type: response")
        body += payload
    else:
        head += ["WARC-Type: revisit", f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload; a damaged record raises."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError(f"record {fields['warc-record-id']} has another length than it says")
    payload = rest[:n].partition(b"\r\n\r\n")[2]
    if fields["warc-type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if fields["warc-payload-digest"] != f"sha1:{digest}":
            raise ValueError(f"record {fields['warc-record-id']} doesn't match its digest")
    return fields, payload


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_from: int = 1000,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
    date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record per row and return the manifest.

    The payload is the text in UTF-8, null as empty. Of the rows whose equal
    payload has at least `revisit_from` bytes, the one with the largest id is a
    response and the others are revisits that refer to it; among rows that share
    this id, one is. Null ids are smallest. A null url leaves its header out.
    An empty table writes nothing.
    """
    folder = folder or shared_dir(pages.sparkSession, "warc")
    rows = pages.select(
        row_number(None),
        F.col(id_col).alias("id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("key", F.sha2("payload", 256))
    many = stored(
        rows.filter(F.length("payload") >= revisit_from)
        .groupBy("key").agg(F.max(F.struct("id", ROW)).alias("top"), F.count("*").alias("n")).filter("n > 1"),
        "warc-repeats",
    )
    chosen = rows.join(many, "key", "left").select(
        ROW, "id", "url", "payload",
        F.col("top.id").alias("top_id"), F.col("top")[ROW].alias("top_row"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, places = None, []
        for batch in batches:
            for row, key, url, payload, top_id, top_row in zip(*(c.to_pylist() for c in batch.columns)):
                bundle = bundle or Bundle(folder, frame_bytes)
                name = record_name(key, row)
                to = record_name(top_id, top_row) if top_row is not None and top_row != row else None
                places.append((name, bundle.uri, *bundle.add(record(name, url, payload, to, date))))
                if bundle.total >= bundle_bytes:
                    bundle.close()
                    bundle = None
                    yield manifest_batch(places)
                    places = []
        if bundle:
            bundle.close()
            yield manifest_batch(places)

    return stored(chosen.mapInArrow(write, MANIFEST), "warc-manifest")


def record_name(key, row: int) -> str:
    return f"urn:x-page:{'*' if key is None else quote(str(key), safe='-')}:{row}"


def manifest_batch(places: list[tuple]) -> pa.RecordBatch:
    kinds = [("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(zip(*places), kinds)], [n for n, _ in kinds]
    )


def read_archives(manifest: DataFrame) -> DataFrame:
    """Read every record of the manifest back, one frame at a time.

    Returns record_id, record_type, refers_to (a record identifier), payload_bytes,
    payload_digest (lower-case hex) and payload (null for a revisit). Both figures
    are of the full payload. A damaged frame or record fails the job.
    """
    # A frame's row is small however much it stands for, so Spark can't tell how many tasks are due.
    size = manifest.agg(F.sum("length")).first()[0] or 0
    frames = (
        manifest.repartition(1 + size // READ_BYTES, "bundle", "frame").groupBy("bundle", "frame")
        .agg(F.collect_list(F.struct("offset", "length")).alias("places"))
    )

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, table = None, None, []
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for uri, frame, places in zip(*(c.to_pylist() for c in batch.columns)):
                if uri != name:
                    fs, path = filesystem(uri)
                    name, file = uri, fs.open_input_file(path)
                    table = seek_table(file)
                at, packed, plain = table[frame]
                data = unpack.decompress(file.read_at(packed, at), max_output_size=plain)
                got = [parse(data[p["offset"] : p["offset"] + p["length"]]) for p in places]
                heads = [h for h, _ in got]
                digests = [base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex() for h in heads]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([h["warc-record-id"][1:-1] for h in heads], pa.string()),
                        pa.array([h["warc-type"] for h in heads], pa.string()),
                        pa.array([h["warc-refers-to"][1:-1] if "warc-refers-to" in h else None for h in heads], pa.string()),
                        pa.array([int(h["x-payload-length"]) for h in heads], pa.int64()),
                        pa.array(digests, pa.string()),
                        pa.array([p if h["warc-type"] == "response" else None for h, p in got], pa.binary()),
                    ],
                    ["record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"],
                )

    return frames.mapInArrow(
        load,
        "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary",
    )


def page_of(name: str, kind: str = "long"):
    """The page id inside a record identifier, null for a null id."""
    part = F.split(F.col(name), ":")[2]
    return F.when(part != "*", F.url_decode(part)).cast(kind)


def page_records(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write all pages, read the archives back, and describe each record by page."""
    kind = id_type(pages, id_col)
    back = read_archives(write_archives(pages, id_col=id_col, **options))
    return back.select(
        page_of("record_id", kind).alias(id_col),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of("refers_to", kind).alias("refers_to"),
    )
