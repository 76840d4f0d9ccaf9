"""Groups of similar sets from buckets of candidates, without comparing all pairs of a bucket.

Given buckets in which every linked pair of sets meets at least once, this finds the
groups. Links are Jaccard similarities of at least `percent` hundredths; as a number of
differences (elements that only one of two sets has) that is at most
(100 - percent) / (100 + percent) of the sum of the sizes.

Copies that differ from one text in places of their own meet in the same buckets
without being linked to each other. So every set is compared with a hub, the heaviest set
of its buckets, and all of a bucket with one hub. What a set lacks of the hub's and has
besides, its differences from the hub, stand for it from then on:

* The differences between two sets of a family (at least half similar to the same hub)
  are those that one of them has and the other one hasn't. Two sets neither of which is
  linked to the hub, or only one of which is, must share a least number of differences
  from it to be linked to each other. They meet by a prefix filter: of each set only its
  rarest differences, as many as can be missing and one, are looked up.
* 1 - similarity is a metric. A set close to the hub is linked to none that is far from it.

A bucket is done when all of it is one group or one family. Of other buckets the sets
close to a hub leave. The rest, unlike its hub, isn't compared bucket by bucket: it meets
anew by a prefix filter on the sets' own elements, those that the hub hasn't first, as a
bucket's common elements are in its hub. Sets that share one of these are a bucket with a hub
again; those that are left of it meet once more by elements that this hub hasn't, and are
compared if sizes and places let them be linked.
Everything is exact; nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanguard.llm.common import ROW, pack, slices, stored
from spanguard.llm.components import components
from spanguard.llm.hashing import shingle_sets

CHUNK = 1 << 18
#: Least similarity of a family's sets with its hub.
FAMILY = 0.5
#: Rounds in which unlinked sets look for hubs among themselves, while one in HARVEST of them links.
HARVESTS, HARVEST = 4, 10
#: Sets that share an element, beyond which it is one of the last to be looked up.
CROWD = 8
#: Against rounding of similarities.
EPS = 1e-9


def near_hub(percent: int) -> float:
    """A set this similar to a hub is linked to none outside of the hub's family."""
    return min(1.0, FAMILY + (100 - percent) / 100) - EPS


def compare(pairs: DataFrame, texts: DataFrame, words: int, percent: int, whole: bool = False) -> DataFrame:
    """For each (node, hub) the sizes, the number of differences, the similarity,
    in families the differences, and of sets not close to the hub the head: elements that the
    hub hasn't, then others, twice as many as can be missing of a linked set and one, or all.
    """
    schema = "node long, hub long, n long, hub_n long, d long, sim double, diff array<long>, head array<long>"
    near = near_hub(percent)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in slices(slices(batches, 2, CHUNK), 3, CHUNK):
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            different = list(dict.fromkeys([*left, *right]))
            sets = dict(zip(different, shingle_sets([open_.decompress(p) for p in different], words)))
            out = []
            for x, y in zip(left, right):
                x, y = sets[x], sets[y]
                diff = np.setxor1d(x, y, assume_unique=True)
                both = (len(x) + len(y) - len(diff)) // 2
                sim = both / max(1, len(x) + len(y) - both)
                head = None
                if sim < near:
                    inside = np.isin(x, y, assume_unique=True)
                    head = np.concatenate([x[~inside], x[inside]]).view(np.int64)
                    head = head if whole else head[: 2 * (len(x) + 1 - -(-percent * len(x) // 100))]
                out.append((len(x), len(y), len(diff), sim, diff.view(np.int64) if sim >= FAMILY else None, head))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *arrays], ["node", "hub", "n", "hub_n", "d", "sim", "diff", "head"])

    first = texts.select("node", F.col("packed").alias("p"))
    second = texts.select(F.col("node").alias("hub"), F.col("packed").alias("q"))
    found = pairs.join(first, "node").join(second, "hub").select("node", "hub", "p", "q")
    return stored(found.mapInArrow(check, schema), "compared")


class Groups:
    """The groups found so far: the smallest node linked, of every node."""

    def __init__(self, weights: DataFrame):
        self.labels = stored(weights.select("node", "weight", F.col("node").alias("comp")), "labels")

    def of(self, name: str, comp: str) -> DataFrame:
        return self.labels.select(F.col("node").alias(name), F.col("comp").alias(comp))

    def link(self, pairs: DataFrame) -> None:
        """Join the groups of the linked pairs (a, b)."""
        if pairs.isEmpty():
            return
        edges = pairs.join(self.of("a", "ca"), "a").join(self.of("b", "cb"), "b")
        roots = components(edges.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        moved = roots.select(F.col("node").alias("comp"), "root")
        labels = self.labels.join(moved, "comp", "left").select("node", "weight", F.coalesce("root", "comp").alias("comp"))
        self.labels = stored(labels, "labels")

    def open(self, entries: DataFrame) -> DataFrame:
        """Those of the entries (key, node) whose bucket holds several groups, with weights."""
        members = entries.join(self.labels, "node")
        keys = members.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
        return stored(members.join(stored(keys, "open"), "key").select("key", "node", "weight"), "members")


def heaviest(members: DataFrame) -> DataFrame:
    """(key, top): the heaviest member of each bucket."""
    return members.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top")).select("key", "top")


def settle(entries: DataFrame, weights: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, comp) of the sets in buckets; comp is the smallest node of the group.

    `entries` are the buckets (key, node), stored; `weights` has each of their nodes once
    with a weight, heavier ones first becoming hubs; `rows` has the texts by row number,
    which the nodes are.
    """
    near = near_hub(percent)
    groups = Groups(weights)
    nodes = groups.labels.select(F.col("node").alias(ROW))
    packed = rows.select(ROW, "text").mapInArrow(pack, f"{ROW} long, packed binary").join(nodes, ROW)
    texts = stored(packed.withColumnRenamed(ROW, "node"), "texts")
    linked = f"{100 + percent} * d <= {100 - percent} * (n + hub_n)"
    tested: list[DataFrame] = []

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def test(pairs: DataFrame) -> DataFrame:
        """Compare the pairs not yet compared."""
        pairs = pairs.filter("node <> hub")
        if tested:
            pairs = pairs.join(union(tested).select("node", "hub"), ["node", "hub"], "left_anti")
        found = compare(stored(pairs, "pairs"), texts, words, percent)
        tested.append(found)
        return found

    def links(parts: list[DataFrame]) -> DataFrame:
        return union(parts).filter(linked).select(F.col("node").alias("a"), F.col("hub").alias("b"))

    def hubs_of(members: DataFrame) -> DataFrame:
        """(node, hub): the heaviest among those that are heaviest in a bucket of the node."""
        best = members.join(stored(heaviest(members), "heaviest"), "key").groupBy("node").agg(F.max("top").alias("top"))
        return stored(best, "hubs")

    def rest(live: DataFrame, pivots: DataFrame) -> DataFrame:
        """What is left of the buckets after all their members have been compared with their pivots."""
        known = union(tested).select("node", "hub", "sim")
        seen = live.join(pivots, "key").join(known, ["node", "hub"], "left")
        seen = stored(seen.select("key", "node", "hub", F.when(F.expr("node = hub"), 1.0).otherwise(F.col("sim")).alias("sim")), "seen")
        whole = seen.groupBy("key", "hub").agg(F.min("sim").alias("far")).groupBy("key").agg(F.max("far").alias("far"))
        open_ = stored(whole.filter(F.col("far") < FAMILY).select("key"), "open")
        left = seen.groupBy("key", "node").agg(F.max("sim").alias("sim")).filter(F.col("sim") < near).select("key", "node")
        return left.join(open_, "key")

    def heads(left: DataFrame, pivots: DataFrame) -> DataFrame:
        """(key, node, n, rank): elements by which what is left of buckets meets, a key being a hub's element.

        Each set is looked up by as many elements as can be missing of a linked set and one.
        First come those that are neither in the hub nor in more than `CROWD` heads.
        """
        need = f"n - ({percent} * n + 99) div 100 + 1"
        pairs = stored(groups.open(left).join(pivots, "key").select("node", "hub").distinct(), "unlike")

        def elements(compared: DataFrame) -> DataFrame:
            own = F.expr("(n + d - hub_n) div 2").alias("own")
            items = compared.select("node", "hub", "n", own, F.posexplode("head").alias("at", "x"))
            return items.withColumn("key", F.xxhash64("hub", "x"))

        def ranked(items: DataFrame) -> DataFrame:
            late = F.expr("coalesce(m, 0) + int(at >= own)")
            return items.join(crowded, "key", "left").withColumn("late", late).selectExpr(
                "key", "node", "hub", "n",
                "row_number() OVER (PARTITION BY node, hub ORDER BY late, at) AS rank",
                "sum(int(late = 0)) OVER (PARTITION BY node, hub) AS first",
                "count(*) OVER (PARTITION BY node, hub) AS held",
            ).filter(f"rank <= {need}")

        items = stored(elements(union(tested).join(pairs, ["node", "hub"])), "items")
        crowded = stored(items.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > CROWD), "crowded")
        some = stored(ranked(items).withColumn("whole", F.expr(f"held = n OR first >= {need}")), "heads")
        short = stored(some.filter("NOT whole").select("node", "hub").distinct(), "short")
        others = ranked(elements(compare(short, texts, words, percent, True)))
        columns = "key", "node", "n", "rank"
        lists = stored(some.filter("whole").select(*columns).unionByName(others.select(*columns)), "looked_up")
        shared = stored(lists.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key"), "counts")
        return stored(lists.join(shared, "key"), "lists")

    members = groups.open(entries)
    if members.isEmpty():
        return groups.labels.select("node", "comp")
    hubs = hubs_of(members)
    test(hubs.select("node", F.col("top.node").alias("hub")))
    common = members.join(hubs, "node").groupBy("key").agg(F.max("top.node").alias("hub"), F.max("top").alias("top"))
    pivots = stored(common.select("key", F.col("top.node").alias("hub")), "pivots")
    test(members.join(pivots, "key").select("node", "hub").distinct())
    live = stored(rest(members.select("key", "node"), pivots), "live")
    relied = len(tested)
    for _ in range(HARVESTS):
        joined = links(tested).select(F.explode(F.array("a", "b")).alias("node")).distinct()
        members = groups.open(entries.join(stored(joined, "joined"), "node", "left_anti"))
        if members.isEmpty():
            break
        found = test(hubs_of(members).select("node", F.col("top.node").alias("hub")))
        if HARVEST * found.filter(linked).count() <= found.count():
            break
    harvested, first = tested[relied:], len(tested)
    groups.link(links(tested))
    lists = heads(live, pivots)
    members = groups.open(lists.select("key", "node"))
    if not members.isEmpty():
        pivots = stored(heaviest(members).select("key", F.col("top.node").alias("hub")), "pivots")
        test(members.join(pivots, "key").select("node", "hub").distinct())
        left = rest(members.select("key", "node"), pivots).join(lists, ["key", "node"])
        left = stored(left.join(groups.of("node", "comp"), "node"), "left")
        test(meetings(left, percent))
    families = union([t for t in tested if not any(t is h for h in harvested)])
    late = common_differences(families, groups, percent)
    groups.link(stored(late.unionByName(links(tested[first:])) if tested[first:] else late, "late"))
    return groups.labels.select("node", "comp")


def meetings(left: DataFrame, percent: int) -> DataFrame:
    """(node, hub) of different groups that may be linked, by sizes and by the places of an element both have."""
    columns = "node", "n", "rank", "comp"
    one, two = (left.select("key", *(F.col(c).alias(f"{c}{i}") for c in columns)) for i in (1, 2))
    # After the first element that two sets share, they share no more than one of them has left.
    meet = (
        f"node1 < node2 AND comp1 <> comp2 AND 100 * least(n1, n2) >= {percent} * greatest(n1, n2)"
        f" AND {100 + percent} * (1 + least(n1 - rank1, n2 - rank2)) >= {percent} * (n1 + n2)"
    )
    pairs = one.join(two, "key").filter(meet)
    return pairs.select(F.col("node1").alias("node"), F.col("node2").alias("hub")).distinct()


def common_differences(tested: DataFrame, groups: Groups, percent: int) -> DataFrame:
    """Linked pairs (a, b) of families' sets in different groups, from their differences from the hub.

    With d differences of a set of n elements from a hub of h, and r the share of the sizes'
    sum that may differ, two linked sets share (d + d' - r(n + n')) / 2 differences at least.
    If the second one isn't linked to the hub, d' > r(n' + h), so the first one must share
    more than (d + r(h - n)) / 2 of its own. A set not linked to the hub must share
    (d - r(n + h)) / 2 with any other.
    """
    family = tested.filter(F.col("sim") >= FAMILY).join(groups.of("node", "comp"), "node").join(groups.of("hub", "hub_comp"), "hub")
    family = family.withColumn("open", F.expr("comp <> hub_comp"))
    some = stored(family.filter("open").select("hub").distinct(), "some")
    family = stored(family.join(some, "hub").select("hub", "node", "comp", "open", "n", "hub_n", "d", "diff"), "family")
    items = family.select("hub", "node", "comp", "open", "n", "hub_n", "d", F.explode("diff").alias("x"))
    counts = stored(items.groupBy("hub", "x").agg(F.count("*").alias("m")).filter("m > 1"), "counts")
    items = items.join(counts, ["hub", "x"])
    more, less = 100 + percent, 100 - percent
    half = f"greatest(1, floor(({more} * d + {less} * (hub_n - n)) / {2 * more}.0D) + 1)"
    least = f"greatest(1, ceil(({more} * d - {less} * (n + hub_n)) / {2 * more}.0D))"
    # Elements that no other set has come first: there are d less those left here.
    order = f"d - count(*) OVER (PARTITION BY hub, node) + row_number() OVER (PARTITION BY hub, node ORDER BY m, x)"
    ranked = items.withColumn("rank", F.expr(order)).withColumn("half", F.expr(f"rank <= d - {half} + 1"))
    columns = "node", "comp", "open", "half", "rank", "n", "d"
    index = stored(ranked.filter(f"half OR open AND rank <= d - {least} + 1").select("hub", "x", *columns), "index")
    one, two = (
        index.filter(side).select("hub", "x", *(F.col(c).alias(f"{c}{i}") for c in columns)) for i, side in ((1, "open"), (2, "half"))
    )
    # After the first difference that two sets share, they share no more than one of them has left.
    meet = (
        f"comp1 <> comp2 AND {more} * abs(d1 - d2) <= {less} * (n1 + n2) AND (NOT open2 OR half1 AND node1 < node2)"
        f" AND {2 * more} * (1 + least(d1 - rank1, d2 - rank2)) >= {more} * (d1 + d2) - {less} * (n1 + n2)"
    )
    pairs = one.join(two, ["hub", "x"]).filter(meet).select("hub", F.col("node1").alias("a"), F.col("node2").alias("b")).distinct()
    pairs = stored(pairs, "meeting")
    for name in ("a", "b"):
        side = family.select("hub", F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", "d", "diff")))
        pairs = pairs.join(side, ["hub", name])
    shared = F.size(F.array_intersect("diff_a", "diff_b"))
    return pairs.filter(more * (F.col("d_a") + F.col("d_b") - 2 * shared) <= less * (F.col("n_a") + F.col("n_b"))).select("a", "b").distinct()
