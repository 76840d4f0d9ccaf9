"""N-gram Jaccard join by PartEnum signatures: exact groups of similar shingle sets.

Sizes are cut into bands such that linked sets lie in the same band or in two that
follow each other; a set takes part in the instance of its band and in the next one's.
An instance fixes how many elements two of its sets can differ in (k), and deals the
domain of all shingles over more than k partitions by a hash. What a set has in a
partition is a signature, the enumerated subsets being single partitions. Linked sets
differ in k partitions at most, so they share all other signatures.

As there are about 3k/2 partitions, they share a third of them at least. Hence a set
keeps only its rarest signatures, k + 1 of them, and two linked sets still share one
(a prefix filter on signatures). Signatures that no other set has are the rarest, so a
text that shares one passage with thousands of others, but is otherwise its own, keeps
no signature that leads anywhere. k is the set's own bound, from its size.

Partitions without elements are no signatures. A set with elements in k partitions or
fewer keeps all it has, and is dealt once more by another hash; after LEVELS such
deals the sets left share one signature. So nothing is ever lost.

Rows with equal sets are one class. The buckets of the kept signatures are settled
in `families`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanguard.llm.common import ROW, as_bytes, id_type, row_number, slices, stored
from spanguard.llm.families import settle
from spanguard.llm.hashing import mixed, shingle_sets

#: Words in a shingle, and the least similarity in hundredths.
WORDS, PERCENT = 5, 80
LEVELS = 8
CHUNK = 1 << 18
#: Digests of sets that a task remembers, so that of its copies only one has signatures.
REMEMBERED = 1 << 17


def first_sizes(percent: int, most: int = 1 << 40) -> np.ndarray:
    """The least size of each band."""
    sizes = [1]
    while sizes[-1] <= most:
        sizes.append(sizes[-1] * 100 // percent + 1)
    return np.array(sizes, np.int64)


class PartEnum:
    """Signatures of sets for one least similarity."""

    def __init__(self, percent: int):
        self.percent, self.sizes = percent, first_sizes(percent)

    def differing(self, size_sum: np.ndarray) -> np.ndarray:
        """The most differences of two linked sets whose sizes have this sum."""
        return size_sum * (100 - self.percent) // (100 + self.percent)

    def instance(self, n: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sets of n elements: the instance, its partitions and the set's own bound k."""
        own = np.searchsorted(self.sizes, n, "right") - 1 + which
        last = self.sizes[own + 1] - 1
        k = self.differing(2 * last)
        return own, k + 3 + k // 2, self.differing(n + np.minimum(last, n * 100 // self.percent))

    def signatures(self, sets: list[np.ndarray], which: int):
        """For own (0) or next (1) instance: the set of each signature, the signature, its level.

        Also, for each set and level, the partitions that hold elements, or -1 if it isn't
        dealt at that level.
        """
        n = np.array([len(s) for s in sets], np.int64)
        own, parts, k = self.instance(n, which)
        used = np.full((len(sets), LEVELS), -1, np.int64)
        out, at = [], np.flatnonzero(k > 0)  # no differences: linked to equal sets only
        for level in range(LEVELS):
            if not len(at):
                break
            values = np.concatenate([sets[i] for i in at])
            of = np.repeat(np.arange(len(at)), n[at])
            start = np.cumsum(parts[at]) - parts[at]
            dealt = mixed(values, np.uint64(2 * level + 1))
            cell = start[of] + ((dealt >> np.uint64(32)) % parts[at][of].astype(np.uint64)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            total = np.add.reduceat(mixed(values, np.uint64(77))[order], first)
            owner = of[order][first]
            name = (own[at][owner] * LEVELS + level).astype(np.uint64)
            place = (cell[first] - start[owner]).astype(np.uint64)
            out.append((at[owner], mixed(mixed(total, place), name), np.full(len(owner), level)))
            used[at, level] = np.bincount(owner, minlength=len(at))
            at = at[used[at, level] <= k[at]]
        if len(at):  # sparse at all levels
            name = (own[at] * LEVELS + LEVELS).astype(np.uint64)
            out.append((at, mixed(name, np.uint64(0)), np.full(len(at), LEVELS)))
        columns = zip(*out) if out else ((), (), ())
        return *(np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns), used, k


def digests(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Two sums over each set, which with its size identify it."""
    with np.errstate(over="ignore"):
        return [
            tuple(int(x.sum(dtype=np.uint64).view(np.int64)) for x in (s, s * (s >> np.uint64(7) | np.uint64(1)))) for s in sets
        ]


def sketches(rows: DataFrame, words: int, kind: str) -> DataFrame:
    """Row, id, set size and set digest of each text."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, CHUNK):
            sets = shingle_sets(as_bytes(batch.column(2)), words)
            one, two = zip(*digests(sets))
            columns = [pa.array(c, pa.int64()) for c in ([len(s) for s in sets], one, two)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], [ROW, "id", "n", "d1", "d2"])

    return rows.mapInArrow(sketch, f"{ROW} long, id {kind}, n long, d1 long, d2 long")


def signatures(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, row, place, spare) of all rows' signatures, but for copies within a task.

    `place` is twice the level, plus one in the next band's instance; `spare` is the number
    of signatures there that the set must keep, less those it has.
    """
    partenum = PartEnum(percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in slices(batches, 1, CHUNK):
            sets = shingle_sets(as_bytes(batch.column(1)), words)
            fresh = []
            for i, key in enumerate(digests(sets)):
                if len(sets[i]) and seen.pop(key, None) is None:
                    fresh.append(i)
                seen[key] = True  # the latest comes last
                if len(seen) > REMEMBERED:
                    del seen[next(iter(seen))]
            if not fresh:
                continue
            number = batch.column(0).to_numpy()[fresh]
            for which in (0, 1):
                of, key, level, used, k = partenum.signatures([sets[i] for i in fresh], which)
                count = np.where(level < LEVELS, used[of, np.minimum(level, LEVELS - 1)], 0)
                columns = (key.astype(np.uint64).view(np.int64), number[of], 2 * level + which, k[of] + 1 - count)
                kinds = (pa.int64(), pa.int64(), pa.int8(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", ROW, "place", "spare"])

    return rows.select(ROW, "text").mapInArrow(sign, f"key long, {ROW} long, place byte, spare int")


def rarest(entries: DataFrame) -> DataFrame:
    """Of the shared signatures (key, node, place, spare, m) those that a set keeps.

    Ranked by m, the sets that have it; those of this set alone come before all others. A
    set with k signatures or fewer keeps all.
    """
    own = "PARTITION BY node, place"
    rank = f"row_number() OVER ({own} ORDER BY m, key) - count(*) OVER ({own})"
    return entries.withColumn("rank", F.expr(rank)).filter("rank <= spare").select("key", "node")


def jaccard_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """Each row with the group that its links lead through.

    Two texts are linked if 100 * |intersection| >= percent * |union| of their sets of
    word shingles; a text of fewer words has all of them as its one shingle. A text without
    words (null or empty ones too) has an empty set and is linked with nothing, not even its
    copies. Returns id, n_shingles, component_id (the smallest id reachable; null ids are
    largest) and the row's number. Repeated rows are linked if they have words. An empty table
    gives an empty result.
    """
    kind = id_type(docs, id_col)
    rows = docs.select(row_number(row_col), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = stored(sketches(rows, words, kind), "sketches")
    same = ["n", "d1", "d2"]
    classes = stored(sketched.filter("n > 0").groupBy(*same).agg(F.min(ROW).alias("node")), "classes")
    members = stored(sketched.join(classes, same, "left").select(ROW, "id", "n", F.coalesce("node", ROW).alias("node")), "members")

    alike = F.count("*").over(Window.partitionBy("key"))
    shared = stored(signatures(rows, words, percent).withColumn("m", alike).filter("m > 1").drop("m"), "shared")
    # Copies of several tasks are one node; then signatures are counted anew.
    nodes = shared.join(members.select(ROW, "node"), ROW).drop(ROW).repartition("key").distinct()
    entries = stored(nodes.withColumn("m", alike).filter("m > 1"), "counted")
    weights = entries.groupBy("node").agg(F.sum("m").alias("weight"))
    kept = stored(rarest(entries), "kept")
    counts = stored(kept.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key"), "counts")
    kept = stored(kept.join(counts, "key"), "buckets")
    weights = weights.join(kept.select("node").distinct(), "node")

    labels = settle(kept, weights, rows, words, percent)
    grouped = stored(members.join(labels, "node", "left").select(ROW, "id", "n", F.coalesce("comp", "node").alias("comp")), "grouped")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first")
    heads = stored(grouped.groupBy("comp").agg(first), "heads")
    return grouped.join(heads, "comp").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"), ROW
    )
