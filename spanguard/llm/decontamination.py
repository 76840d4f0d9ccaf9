"""Benchmark decontamination: short test items inside long documents.

A size-partitioned MinHash containment search, with DataFrame functions only. The
similarity that matters is containment, the share of an item's shingles that a
document holds, however long the document is. A document's own MinHash would hardly
ever be a shingle of a short item, so the sketch is the item's: its smallest hashes.
Items are partitioned by the size of their sets, and the partition sets how many
coordinates their sketches need:

* small items: one more than the shingles that may be missing, so that a document
  that contains enough of the item holds at least one coordinate, with certainty;
* large items: as many as keep the probability that all are missing below `MISS`.

A document whose set is too small to hold enough of an item is no candidate for its
partition. Candidates are verified on the words themselves: the distinct shingles of
item and document are intersected. Sketches are broadcast only if their number,
which is counted first, is small; otherwise both sides are shuffled by hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanguard.llm.common import ROW, row_number, stored

#: Words in a shingle, and the least containment in hundredths.
WORDS, PERCENT = 5, 80
MISS = 1e-9
#: Sketch rows (24 bytes each) that are broadcast at most.
BROADCAST_ROWS = 200_000


def word_list(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def over_shingles(words: Column, size: int, make, lengths: tuple[int, ...] = ()) -> Column:
    """`make` of the words of each shingle, in order; fewer words than `size` are one shingle.

    The distinct runs of each of `lengths` words follow. The word list is bound to a
    variable, so it is evaluated once per row.
    """

    def runs(w: Column, k: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: make([F.array_join(F.slice(w, i + 1, k), " ")]))
        return F.when(F.size(w) >= k, F.array_distinct(each)).otherwise(F.array().cast("array<string>" if make is joined else "array<long>"))

    def all_of(w: Column) -> Column:
        return (
            F.when(F.size(w) == 0, F.array().cast("array<string>") if make is joined else F.array().cast("array<long>"))
            .when(F.size(w) < size, F.array(make([F.array_join(w, " ")])))
            .otherwise(
                F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: make([F.get(w, i + k) for k in range(size)]))
            )
        )

    whole = all_of if not lengths else lambda w: F.concat(all_of(w), *[runs(w, k) for k in lengths])
    return F.transform(F.array(words), whole)[0]


def hashed(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def joined(words: list[Column]) -> Column:
    return F.concat_ws(" ", *words)


def coordinates(size: Column, percent: int) -> Column:
    """Sketch coordinates of an item, by the partition its size is in."""
    enough = math.ceil(math.log(MISS) / math.log(1 - percent / 100)) if percent < 100 else 1
    missing = F.expr(f"(100 - {percent}) * n div 100")
    return F.least(missing + 1, F.lit(enough)).cast("int")


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    row_col: str | None = None,
    short_items: bool = False,
) -> DataFrame:
    """Pairs of a document and an item with 100 * |shared| >= percent * |item|.

    Sets are of distinct shingles of `words` words; a text of fewer words is one
    shingle, one without words (null and empty ones too) has none and is in no pair.
    With `short_items`, an item of fewer than `words` words is found wherever its words
    stand next to each other in a document, not only in one that has no other words.
    Repeated rows and null ids are rows like others, each with pairs of its own.
    Returns the document's id, the item's id, n_shared, n_item, containment and the
    document's row number. Without documents or items the result is empty.
    """
    tests = items.select(
        F.monotonically_increasing_id().alias("item"),
        F.col(item_col).alias("item_id"),
        F.size(word_list(F.col(item_text_col))).alias("length"),
        F.array_distinct(over_shingles(word_list(F.col(item_text_col)), words, joined)).alias("parts"),
        F.array_sort(F.array_distinct(over_shingles(word_list(F.col(item_text_col)), words, hashed))).alias("hashes"),
    ).filter(F.size("parts") > 0)
    tests = stored(tests.withColumn("n", F.size("parts")), "items")
    lengths = ()
    if short_items:
        lengths = tuple(sorted(r["length"] for r in tests.filter(F.col("length") < words).select("length").distinct().collect()))
    sketch = stored(
        tests.select(
            "item",
            F.expr(f"({percent} * n + 99) div 100").alias("need"),
            F.explode(F.slice("hashes", 1, coordinates(F.col("n"), percent))).alias("hash"),
        ),
        "item-sketches",
    )
    rows = docs.select(row_number(row_col), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shingles = rows.select(ROW, over_shingles(word_list(F.col("text")), words, hashed, lengths).alias("hashes")).select(
        ROW, F.size("hashes").alias("size"), F.explode("hashes").alias("hash")
    )
    small = sketch.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = shingles.join(F.broadcast(sketch) if small else sketch, "hash").filter("size >= need")
    candidates = stored(found.select(ROW, "item").distinct(), "candidates")
    texts = candidates.join(rows, ROW).select(
        ROW, "id", "item", F.array_distinct(over_shingles(word_list(F.col("text")), words, joined, lengths)).alias("whole")
    )
    shared = F.size(F.array_intersect("parts", "whole"))
    verified = texts.join(tests.select("item", "item_id", "n", "parts"), "item").select(
        ROW, "id", "item_id", "n", shared.alias("shared")
    )
    return verified.filter(f"100 * shared >= {percent} * n").select(
        F.col("id").alias(id_col),
        F.col("item_id").alias(item_col),
        F.col("shared").cast("long").alias("n_shared"),
        F.col("n").cast("long").alias("n_item"),
        (F.col("shared") / F.col("n")).alias("containment"),
        ROW,
    )
