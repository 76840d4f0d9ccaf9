"""Near-duplicate groups: circulant MinHash, banding, exact Jaccard similarity.

Rows with equal shingle sets are one class from the start, so a group of copies is
one node however large it is. Classes get a signature from two permutations, one of
them shifted circularly, and meet in the buckets of its bands.

Within a bucket no list of all pairs is made: sets are compared with hubs and stand
for each other by their differences from these (`families`), which settles every two
members of a bucket exactly. Nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanguard.llm.common import ROW, as_bytes, id_type, row_number, slices, stored
from spanguard.llm.families import settle
from spanguard.llm.hashing import band_keys, circulant_signatures, shingle_sets

#: Words in a shingle, and the least similarity in hundredths.
WORDS, PERCENT = 5, 80
#: A linked pair shares no bucket with at most this probability.
MISS = 1e-6
MOST_BANDS = 20
CHUNK = 1 << 18


def banding(percent: int, miss: float = MISS, most: int = MOST_BANDS) -> tuple[int, int]:
    """Rows per band and bands: the most rows for which `most` bands keep the miss."""
    rows, bands = 1, 1
    for r in range(1, 9):
        need = 1 if percent >= 100 else math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** r))
        if need <= most:
            rows, bands = r, need
    return rows, bands


def sketches(docs: DataFrame, words: int, percent: int, kind: str) -> DataFrame:
    """Row, id, set size, set digest (two longs) and band keys of each text."""
    rows, bands = banding(percent)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, CHUNK):
            sets = shingle_sets(as_bytes(batch.column(2)), words)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            if full:
                found = band_keys(circulant_signatures([sets[i] for i in full], rows * bands), rows)
                for i, k in zip(full, found):
                    keys[i] = k
            with np.errstate(over="ignore"):
                total = [int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else None for s in sets]
                squares = [int((s * (s >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64).view(np.int64)) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(total, pa.int64()), pa.array(squares, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                [ROW, "id", "n", "d1", "d2", "bands"],
            )

    return docs.mapInArrow(sketch, f"{ROW} long, id {kind}, n long, d1 long, d2 long, bands array<long>")


def link(classes: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, comp) of the classes that share buckets; comp is the smallest node linked."""
    buckets = classes.select("node", F.explode("bands").alias("key"))
    shared = stored(buckets.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "shared")
    entries = stored(buckets.join(shared, "key"), "buckets")
    weights = entries.groupBy("node").agg(F.sum("m").alias("weight"))
    return settle(entries.select("key", "node"), weights, rows, words, percent)


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """Each row with the component of near-duplicates it belongs to.

    Two texts are linked if 100 * |intersection| >= percent * |union| of their sets
    of word shingles. A text without words (null or empty ones too) has an empty set
    and is linked with nothing, not even its copies. Returns id, n_shingles,
    component_id (the smallest id reachable; null ids are largest), kept (true for
    one row of each component) and the row's number. Repeated rows are linked if
    they have words. An empty table gives an empty result.
    """
    kind = id_type(docs, id_col)
    rows = docs.select(row_number(row_col), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = stored(sketches(rows, words, percent, kind), "sketches")
    same = ["n", "d1", "d2"]
    classes = stored(
        sketched.filter("n > 0").groupBy(*same).agg(F.min(ROW).alias("node"), F.first("bands").alias("bands")), "classes"
    )
    labels = link(classes, rows, words, percent).select("node", "comp")
    named = stored(
        classes.join(labels, "node", "left").select(*same, F.coalesce("comp", "node").alias("comp")), "named"
    )
    members = stored(
        sketched.join(named, same, "left").select(ROW, "id", "n", F.coalesce("comp", F.col(ROW)).alias("comp")),
        "grouped",
    )
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", ROW)).alias("first")
    heads = stored(members.groupBy("comp").agg(first), "heads")
    return members.join(heads, "comp").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("first.id").alias("component_id"),
        (F.col("first")[ROW] == F.col(ROW)).alias("kept"),
        ROW,
    )
