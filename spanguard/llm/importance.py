"""Importance resampling towards a target: n-gram buckets, bit-sliced weights, Gumbel draw.

The features of a text are its runs of one to three words, each hashed into one of
10,000 buckets. Bucket counts of the corpus and of the target texts give every bucket
a gain, a scaled and rounded log ratio. A document's weight is the sum of the gains
over its features. It is computed bit-sliced: bit i of all of a document's bucket
counts is a plane of 10,000 bits, bit j of all gains (in two's complement, so the
last plane counts negative) another, and the weight is the sum of 2^(i+j) times the
number of bits that both have. All of it is integer arithmetic, so the weights are exact.

Three passes: count the target and the corpus (a task sends at most 10,000 sums),
weigh the documents, rank the draw. Only the 10,000 gains go to the driver. The rank
is a position in a table stored in order, plus the sizes of the partitions before.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanguard.llm.common import as_bytes, id_type, slices, stored

BUCKETS = 10_000
#: Least words of a document that can be drawn, and the share drawn, in hundredths.
LEAST_WORDS, SHARE = 20, 5
SEED = 42
CHUNK = 1 << 18
#: Words hashed at a time, and documents whose bit planes are built at a time.
BLOCK, PLANES = 1 << 17, 64
#: Longest word hashed by columns of bytes.
LONG = 48

#: Bytes of words: digits, a-z and all above ASCII; A-Z count as a-z.
WORD = np.ones(256, bool)
WORD[:128] = False
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def byte_table() -> np.ndarray:
    """Of the CRC's register: what a byte that leaves it puts in."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table.astype(np.uint32)


CRC = byte_table()


def moved(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its values on each of the four bytes."""
    return table[..., 0, :][x & 255] ^ table[..., 1, :][x >> 8 & 255] ^ table[..., 2, :][x >> 16 & 255] ^ table[..., 3, :][x >> 24]


def zero_tables() -> tuple[np.ndarray, np.ndarray]:
    """The maps that 0 to 63 zero bytes make of a checksum, and 64, 128, 256, … of them."""
    x = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
    few = [x]
    while len(few) <= 64:
        few.append(CRC[few[-1] & 255] ^ (few[-1] >> np.uint32(8)))
    many = [few.pop()]
    while len(many) < 32:
        many.append(moved(many[-1], many[-1]))
    return np.array(few), np.array(many)


FEW, MANY = zero_tables()


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of two strings put together, from theirs and the second's length."""
    n = length & 63
    x = FEW[n, 0, first & 255] ^ FEW[n, 1, first >> 8 & 255] ^ FEW[n, 2, first >> 16 & 255] ^ FEW[n, 3, first >> 24]
    k, rest = 0, length >> 6
    while rest.any():
        at = np.flatnonzero(rest & 1)
        x[at] = moved(MANY[k], x[at])
        k, rest = k + 1, rest >> 1
    return x ^ second


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word, byte column by byte column."""
    length = ends - starts
    order = np.argsort(-np.minimum(length, LONG + 1), kind="stable")
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    s, n = starts[order], length[order]
    for j in range(min(LONG, int(n.max(initial=0)))):
        live = int(np.searchsorted(-n, -j, "left"))  # words of more than j bytes come first
        x = state[:live]
        state[:live] = CRC[(x ^ data[s[:live] + j]) & 255] ^ (x >> np.uint32(8))
    out = np.empty(len(starts), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def features(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (first, last, documents, buckets, words): of texts first to last the
    bucket of every run of one to three words and its text, and the words of each.

    A text of more words than a block comes in several.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    word = WORD[data]
    data = np.where((data >= 0x41) & (data <= 0x5A), data + 32, data).astype(np.uint8)
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    stops = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    blank = np.uint32(zlib.crc32(b" "))
    for at in range(0, len(starts), BLOCK):
        upto = min(at + BLOCK, len(starts))
        far = min(upto + 2, len(starts))
        s, e = starts[at:far], ends[at:far]
        own, n = word_crcs(data, s, e), e - s
        text = np.searchsorted(stops, np.arange(at, far), "right")
        documents, crcs, run = [text[: upto - at]], [own[: upto - at]], own
        for width in (2, 3):  # runs of one word fewer, a blank and the word after
            spaced = joined(run[: len(own) - width + 1], blank, np.ones(max(0, len(own) - width + 1), np.int64))
            run = joined(spaced, own[width - 1 :], n[width - 1 :])
            inside = np.flatnonzero(text[width - 1 :] == text[: len(run)])
            inside = inside[inside < upto - at]
            documents.append(text[inside])
            crcs.append(run[inside])
        first, last = int(text[0]), int(text[upto - at - 1])
        words = np.bincount(documents[0] - first, minlength=last - first + 1)
        yield first, last, np.concatenate(documents), (np.concatenate(crcs) % BUCKETS).astype(np.int64), words


def bucket_counts(texts: DataFrame, column: str) -> DataFrame:
    """(bucket, n) over all features of the texts; each task sums its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(iter([batch]), 0, CHUNK):
                for _, _, _, bucket, _ in features(as_bytes(part.column(0))):
                    total += np.bincount(bucket, minlength=BUCKETS)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], ["bucket", "n"])

    return texts.select(column).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def summed(texts: DataFrame, column: str) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for row in bucket_counts(texts, column).collect():  # 10,000 rows at most
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln of the ratio of smoothed shares), in doubles."""
    s_all, t_all = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())],
        np.int64,
    )


def planes(values: np.ndarray, n: int) -> np.ndarray:
    """Bits 0 to n-1 of the values, each plane packed into words of 64 bits: [..., n, words]."""
    out = np.zeros((*values.shape[:-1], n, -(-values.shape[-1] // 64) * 8), np.uint8)
    for i in range(n):
        packed = np.packbits((values >> i & 1).astype(bool), axis=-1)
        out[..., i, : packed.shape[-1]] = packed
    return out.view(np.uint64)


class Weigher:
    """Bit planes of the gains, against which documents' counts are weighed."""

    def __init__(self, gain: np.ndarray):
        bits = max(int(gain.max(initial=0)).bit_length(), int(~gain.min(initial=0)).bit_length()) + 1
        self.gain = planes(gain, bits)
        self.worth = np.array([1 << j for j in range(bits - 1)] + [-(1 << (bits - 1))], np.int64)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        """The weight of each row of bucket counts."""
        out = np.zeros(len(counts), np.int64)
        for i in range(int(counts.max(initial=0)).bit_length()):
            plane = planes(counts >> i, 1)  # [row, 1, words]
            both = np.bitwise_count(plane & self.gain[None]).sum(axis=-1, dtype=np.int64)
            out += (both @ self.worth) << i
        return out


def weigh(texts: list[bytes], weigher: Weigher) -> tuple[np.ndarray, np.ndarray]:
    """Words and weight of each text."""
    words, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for first, last, document, bucket, n in features(texts):
        words[first : last + 1] += n
        order = np.argsort(document, kind="stable")
        document, bucket = document[order], bucket[order]
        for low in range(first, last + 1, PLANES):
            high = min(low + PLANES, last + 1)
            a, b = np.searchsorted(document, [low, high])
            cells = (document[a:b] - low) * BUCKETS + bucket[a:b]
            counts = np.bincount(cells, minlength=(high - low) * BUCKETS).reshape(-1, BUCKETS)
            weight[low:high] += weigher(counts)
    return words, weight


def weighed(docs: DataFrame, id_col: str, text_col: str, gain: np.ndarray) -> DataFrame:
    """Id, words, features and weight of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher = Weigher(gain)
        for batch in slices(batches, 1, CHUNK):
            words, weight = weigh(as_bytes(batch.column(1)), weigher)
            n = words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, n, weight))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "weight"])

    schema = f"id {id_type(docs, id_col)}, n_words long, n_features long, weight long"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def gumbel(key: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel variate) made of a digest of seed and key (null: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with their rank 1, 2, 3 … in the given order, without a window over all.

    They are dealt by ranges and stored in order; a rank is the place in a partition plus
    the sizes of the partitions before.
    """
    place = F.monotonically_increasing_id()
    part = F.shiftright("place", 33).alias("part")
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place), "ranked")
    sizes = placed.groupBy(part).agg(F.count("*").alias("n")).collect()  # a row for each partition
    before, offsets = 0, []
    for row in sorted(sizes):
        offsets.append((row.part, before))
        before += row.n
    offset = placed.sparkSession.createDataFrame(offsets, "part long, before long")
    return (
        placed.withColumn("part", part).join(F.broadcast(offset), "part")
        .withColumn("rank", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1)
        .drop("part", "before", "place")
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    share: int = SHARE,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Draw `share` hundredths of the documents, likelier the more they resemble the target.

    Words are runs of digits, letters a-z (A-Z count as a-z) and characters above ASCII.
    Returns a row per document: id, n_words, n_features (runs of one to three words,
    repeats counted), weight, score (weight plus noise that depends on seed and id) and
    rank, null for documents that aren't drawn. Of the N documents with at least
    `least_words` words, share * N // 100 are drawn, by descending score; ties go to the
    smaller id, null ids last, and repeated rows in any order. Null and empty texts have no
    features and the weight 0; with an empty target every bucket's gain follows from the
    corpus alone; an empty table gives an empty result.
    """
    gain = gains(summed(docs, text_col), summed(target, target_col))
    scored = weighed(docs, id_col, text_col, gain).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    scored = stored(scored, "scored")
    able = ranked(scored.filter(F.col("n_words") >= least_words), F.desc("score"), F.asc_nulls_last("id"))
    able = able.withColumn("rank", F.when(F.col("rank") <= F.lit(share) * F.lit(able.count()) / 100, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return able.unionByName(rest).withColumnRenamed("id", id_col)
