"""Removal of repeated byte strings, found with suffix arrays over shards.

A string of `span` bytes may repeat anywhere in the corpus, so a suffix array of
its own for each document wouldn't do, and one for the corpus would have to order
every byte of it. Instead, strings are dealt to shards by their content:

1. Among the hashes of all grams (short substrings) of a string the smallest is
   its anchor. Equal strings have equal anchors, and neighbouring strings mostly
   share one, so a document becomes segments: an anchor, the strings that start in
   a row with it (the segment owns these starts), and the bytes they cover.
2. Only segments whose anchor occurs at two or more places can hold a repeat.
   Equal segments are counted as one (pre-aggregation by anchor and a second
   64-bit hash), and the bytes of one of them are cut from its document, so a
   group of copies costs as much as one of them.
3. All segments of an anchor go to one shard. Each shard is sorted by induced
   sorting; permuted common prefixes tell which suffixes share `span` bytes; an
   owned start is repeated if its run of such suffixes has two owned starts or more.
4. The repeated starts go back to the documents, which drop the bytes they cover.

An anchor with very many different segments (a common line in many contexts) would
make a shard too large; its strings are dealt one by one, by their own whole
content, instead. Nothing is dropped for size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanguard.llm.common import ROW, as_bytes, id_type, pack, row_number, slices, stored
from spanguard.llm.hashing import Hashes
from spanguard.llm.suffixes import permuted_common_prefixes, suffix_array

SPAN = 200
#: Starts that are hashed at a time; longer documents are cut into pieces that overlap by a string.
PIECE = 1 << 18
#: Low bits of a key that hold a gram's position among the pieces at hand.
POSITION = np.uint64(20)
#: Symbols in a suffix array, unless one anchor alone has more.
SHARD = 1 << 18
#: Different segments of one anchor above which its strings are dealt one by one.
CROWDED = 2000

def smallest(values: np.ndarray, window: int) -> np.ndarray:
    """The minimum of each window, from windows of doubling length."""
    done = 1
    while done * 2 <= window:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = window - done
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def segments(pieces: list[tuple[int, int, bytes]], span: int, gram: int) -> list[np.ndarray]:
    """Anchor, content hash, row, first start and number of owned starts of each segment.

    A piece is a row, the offset of its bytes in the text, and the bytes.
    """
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    hashes = Hashes(data)
    n = len(data) - gram + 1
    grams = hashes.of(slice(0, n), slice(gram, None))
    low = (grams >> POSITION << POSITION) | np.arange(n, dtype=np.uint64)
    anchor = (smallest(low, span - gram + 1) & np.uint64((1 << int(POSITION)) - 1)).astype(np.int64)
    sizes = np.array([len(p[2]) for p in pieces])
    begin = np.cumsum(sizes) - sizes
    strings = sizes - span + 1
    owner = np.repeat(np.arange(len(pieces)), strings)
    start = np.arange(strings.sum()) + (begin - (np.cumsum(strings) - strings))[owner]
    anchor = anchor[start]
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    count = np.diff(np.append(first, len(anchor)))
    s, o = start[first], owner[first]
    content = hashes.of(s, s + count + span - 1) + count.astype(np.uint64)
    offset = np.array([p[1] for p in pieces]) - begin
    rows = np.array([p[0] for p in pieces])
    return [grams[anchor[first]].view(np.int64), content.view(np.int64), rows[o], s + offset[o], count]


def cut_pieces(row: int, data: bytes, span: int) -> Iterator[tuple[int, int, bytes]]:
    for at in range(0, len(data) - span + 1, PIECE):
        yield row, at, data[at : at + PIECE + span - 1]


def repeated_starts(group: list[tuple[int, int, bytes]], span: int) -> list[list[int]]:
    """For each segment (copies, owned starts, bytes) the ranges of repeated starts.

    All segments of an anchor must be in the group.
    """
    sizes = np.array([len(g[2]) + 1 for g in group])
    # A zero byte follows each segment. Owned starts have `span` bytes before it, and
    # a start that hasn't owns nothing, so it may match a zero byte of a text.
    text = np.frombuffer(b"\0".join(g[2] for g in group) + b"\0", np.uint8)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(group)), sizes)
    copies, owned = (np.array([g[i] for g in group]) for i in (0, 1))
    weight = np.where(np.arange(len(text)) - begin[owner] < owned[owner], copies[owner], 0)
    order = suffix_array(text)
    common = permuted_common_prefixes(text, order)[order]
    run = np.cumsum(common < span) - 1
    total = np.bincount(run, weights=weight[order])
    repeated = np.zeros(len(text), bool)
    repeated[order] = total[run] > 1.5
    repeated &= weight > 0
    edge = np.flatnonzero(np.diff(repeated.view(np.int8), prepend=0, append=0))
    out: list[list[int]] = [[] for _ in group]
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        o = owner[a]
        out[o] += [a - int(begin[o]), b - int(begin[o])]
    return out


def covered(found: list[tuple[int, list[int]]], span: int) -> list[tuple[int, int]]:
    """The byte ranges that ranges of starts cover, merged and in order."""
    ranges = sorted((s + a, s + b - 1 + span) for s, flat in found for a, b in zip(flat[::2], flat[1::2]))
    merged: list[tuple[int, int]] = []
    for a, b in ranges:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    span: int = SPAN,
    gram: int | None = None,
    shard: int = SHARD,
    crowded: int = CROWDED,
    digest: bool = False,
) -> DataFrame:
    """Each row without the bytes that any repeated string of `span` bytes covers.

    Texts are UTF-8 bytes, null as empty; strings don't reach across rows, overlap
    counts, and what repeats is judged on the input. Returns id, n_bytes, n_removed,
    spans (maximal removed ranges of bytes) and kept (the other bytes, or with
    `digest` their SHA-256 in hex, so that no text leaves the last task). Repeated
    rows repeat each other. Texts shorter than `span` are kept whole; an empty table
    gives an empty result. Two different segments are taken for one only if two
    64-bit hashes of them and their lengths agree.
    """
    gram = gram or span // 6
    rows = docs.select(row_number(None), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    place = "anchor long, content long, row_no long, start long, owned long"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(pieces):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in segments(pieces, span, gram)],
                ["anchor", "content", ROW, "start", "owned"],
            )

        pieces, size = [], 0
        for batch in batches:
            for row, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                for piece in cut_pieces(row, data, span):
                    pieces.append(piece)
                    size += len(piece[2])
                    if size >= PIECE:
                        yield flush(pieces)
                        pieces, size = [], 0
        if pieces:
            yield flush(pieces)

    # An anchor's segment is one number besides its hashes: fewer bytes to shuffle.
    all_places = rows.select(ROW, "text").mapInArrow(find, place).select(
        "anchor", "content", ROW, F.shiftleft("start", 20).bitwiseOR(F.col("owned")).alias("place")
    )
    # Counts are stored before they are joined: a join can split a hot anchor only if
    # its rows come straight from a shuffle on either side.
    common = stored(
        all_places.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "common"
    )
    places = stored(all_places.join(common, "anchor"), "anchors")
    owned = F.col("place").bitwiseAND(F.lit((1 << 20) - 1)).alias("owned")
    kinds = stored(
        places.groupBy("anchor", "content", owned)
        .agg(F.count("*").alias("copies"), F.first(ROW).alias(ROW), F.first("place").alias("place")),
        "kinds",
    )
    full = stored(
        kinds.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > crowded).select("anchor"), "crowded"
    )
    usual = kinds.join(full, "anchor", "left_anti").select(ROW, "anchor", "content", "place", "copies")
    alone = places.join(full, "anchor").select(ROW, "anchor", "content", "place", F.lit(0).cast("long").alias("copies"))
    wanted = (
        usual.unionByName(alone)
        .groupBy(ROW)
        .agg(F.collect_list(F.struct("anchor", "content", "place", "copies")).alias("places"))
    )

    kind = id_type(docs, id_col)
    texts = rows.select(ROW, "text").mapInArrow(pack, f"{ROW} long, packed binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        names = ["anchor", "content", ROW, "start", "owned", "copies", "bytes"]

        def batch_of(columns):
            arrays = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*(x[:6] for x in columns))]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([p for x in columns for p in x[6]], pa.binary())], names)

        for batch in batches:
            rows, packed, lists = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2)
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            anchor, content, places, copies = (lists.flatten().field(i).to_numpy() for i in range(4))
            full = copies == 0
            starts, owned = places >> 20, places & 0xFFFFF
            found, size = [], 0
            for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                data = open_.decompress(packed[i])
                usual = np.flatnonzero(~full[a:b]) + a
                s, o = starts[usual], owned[usual]
                ends = s + o + (span - 1)
                parts = [data[x:y] for x, y in zip(s.tolist(), ends.tolist())]
                found.append((anchor[usual], content[usual], np.full(len(s), rows[i]), s, o, copies[usual], parts))
                size += int((ends - s).sum())
                for j in (np.flatnonzero(full[a:b]) + a).tolist():
                    at = starts[j] + np.arange(owned[j])
                    part = data[at[0] : at[-1] + span]
                    own = Hashes(np.frombuffer(part, np.uint8)).of(at - at[0], at - at[0] + span).view(np.int64)
                    strings = [part[k : k + span] for k in range(len(at))]
                    one = np.ones(len(at), np.int64)
                    found.append((own, own, np.full(len(at), rows[i]), at, one, one - 1, strings))
                    size += len(at) * span
                if size > 1 << 22:
                    yield batch_of(found)
                    found, size = [], 0
            if found:
                yield batch_of(found)

    cuts = stored(
        texts.join(wanted, ROW).select(ROW, "packed", "places").mapInArrow(
            cut, f"anchor long, content long, {ROW} long, start long, owned long, copies long, bytes binary"
        ),
        "segments",
    )
    # Strings dealt one by one have no count yet.
    singles = cuts.filter("copies = 0")
    repeated = (
        singles.groupBy("anchor", "content", "owned")
        .agg(F.count("*").alias("copies"), F.min("bytes").alias("bytes"))
        .filter("copies > 1")
    )
    columns = "anchor", "content", "copies", "owned", "bytes"
    distinct = cuts.filter("copies > 0").select(*columns).unionByName(repeated.select(*columns))

    def sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, group, size = [], [], 0

        def flush():
            done = [(k, f) for k, f in zip(keys, repeated_starts(group, span)) if f]
            columns = [
                pa.array([k[0] for k, _ in done], pa.int64()),
                pa.array([k[1] for k, _ in done], pa.int64()),
                pa.array([f for _, f in done], pa.list_(pa.int32())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["anchor", "content", "found"])

        for batch in batches:
            for anchor, content, copies, owned, data in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= shard and anchor != keys[-1][0]:
                    yield flush()
                    keys, group, size = [], [], 0
                keys.append((anchor, content))
                group.append((copies, owned, data))
                size += len(data) + 1
        if group:
            yield flush()

    verdicts = stored(
        distinct.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
            sort_shards, "anchor long, content long, found array<int>"
        ),
        "repeats",
    )
    per_row = (
        places.select("anchor", "content", ROW, F.shiftright("place", 20).alias("start"))
        .unionByName(singles.select("anchor", "content", ROW, "start"))
        .join(verdicts, ["anchor", "content"])
        .groupBy(ROW).agg(F.collect_list(F.struct("start", "found")).alias("found"))
    )

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        span_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, 1, 1 << 22):
            lists = batch.column(2)
            bounds = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            starts = lists.flatten().field(0).to_pylist()
            found = lists.flatten().field(1).to_pylist()
            n_bytes, n_removed, spans, kept = [], [], [], []
            for packed, a, b in zip(batch.column(1).to_pylist(), bounds, bounds[1:]):
                data = open_.decompress(packed)
                ranges = covered(list(zip(starts[a:b], found[a:b])), span)
                stops = [0, *(e for r in ranges for e in r), len(data)]
                rest = b"".join([data[x:y] for x, y in zip(stops[::2], stops[1::2])])
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(rest))
                spans.append([{"start": x, "end": y} for x, y in ranges])
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                    pa.array(spans, span_kind), pa.array(kept, pa.string() if digest else pa.binary()),
                ],
                ["id", "n_bytes", "n_removed", "spans", "kept"],
            )

    whole = rows.mapInArrow(pack, f"{ROW} long, id {kind}, packed binary")
    none = F.array().cast("array<struct<start:bigint,found:array<int>>>")
    out = whole.join(per_row, ROW, "left").select("id", "packed", F.coalesce("found", none).alias("found"))
    schema = f"id {kind}, n_bytes long, n_removed long, spans array<struct<start long, end long>>, kept {'string' if digest else 'binary'}"
    return out.mapInArrow(drop, schema).withColumnRenamed("id", id_col)


def removal_digest(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the digest of what `remove_repeats(…, digest=True)` keeps."""
    return removed.select(
        id_col, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256")
    )
