"""Spelling variants: words one edit apart, by composing finite-state acceptors.

A set of words is a minimised acceptor V. Composed with the transducer E that makes
exactly one edit and with V again, it accepts the pairs of words one edit apart; states
of the composition are pairs of states, and as V is deterministic, both are the same
until the edit is made. Accepted pairs are enumerated, so no pair of words that share a
partition is looked at for its own sake.

The vocabulary is never in one place. Words one edit apart agree before the edit and
after it, so one acceptor is built for each initial state: what lies outside a window in
which the edit is looked for, a prefix (and, read from the end, a suffix), is the path
that leads to it. A pair is reported only by the window that holds its first difference.
Windows are halves of the words at first; those of a partition with too many words are
halved again, down to a single place, where the alphabet bounds the partition. Words of
c and c + 1 code points meet in class c.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanguard.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
#: Least code points and occurrences of a word, and times a form must occur as often.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Of the occurrences, one in so many loses a code point (by a checksum).
SLIPS = 31
#: Words of an acceptor; beyond it the window is halved.
WORDS = 2000


def occurrence(run: Column, key: Column) -> Column:
    """The run as it counts: one in SLIPS, chosen by a checksum, loses a code point."""
    check = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(check, F.char_length(run)).cast("int")
    cut = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(F.pmod(check, F.lit(SLIPS)) == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n) of the words long and frequent enough."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUNS), F.lit(0))).alias("run"))
    long = runs.filter(F.char_length("run") >= LEAST_LENGTH)
    words = long.select(occurrence(F.translate("run", UPPER, LOWER), F.col("id")).alias("word"))
    counts = words.filter(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT)


class Acceptor:
    """The minimised acceptor of sorted, distinct words."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.lengths: list[int] = []  # bit k: a word of k more code points is accepted
        known: dict[tuple, int] = {}
        path, before = [(False, {})], ""

        def close(upto: int) -> int | None:
            state = None
            while len(path) > upto:
                final, arcs = path.pop()
                key = (final, *arcs.items())
                state = known.get(key)
                if state is None:
                    state = known[key] = len(self.arcs)
                    self.arcs.append(arcs)
                    lengths = int(final)
                    for target in arcs.values():
                        lengths |= self.lengths[target] << 1
                    self.lengths.append(lengths)
                if path:
                    path[-1][1][before[len(path) - 1]] = state
            return state

        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            close(shared + 1)
            path.extend((False, {}) for _ in range(len(word) - shared))
            path[-1] = (True, path[-1][1])
            before = word
        self.start = close(0)

    def common(self, s: int, t: int, n: int) -> list[str]:
        """What both states accept of n code points."""
        out, todo = [], [(s, t, n, "")]
        while todo:
            s, t, n, done = todo.pop()
            if not (self.lengths[s] & self.lengths[t]) >> n & 1:
                continue
            if n == 0:
                out.append(done)
                continue
            other = self.arcs[t]
            for a, to in self.arcs[s].items():
                if a in other:
                    todo.append((to, other[a], n - 1, done + a))
        return out

    def edited(self, p: int, n: int) -> list[tuple[str, str]]:
        """Pairs accepted from `p` whose first code points are edited: n of the one, n or n + 1 of the other."""
        out, arcs = [], list(self.arcs[p].items())
        for i, (a, s) in enumerate(arcs):
            if n:
                for b, t in arcs[i + 1 :]:
                    out += [(a + z, b + z) for z in self.common(s, t, n - 1)]
            # `a` inserted; where the rest starts with `a` too, the words differ later on
            out += [(z, a + z) for z in self.common(p, s, n) if z[:1] != a]
        return out

    def pairs(self, n: int, last: int) -> Iterator[tuple[str, str]]:
        """Pairs of words one edit apart, the shorter of n code points, that first differ at `last` or before."""
        memo: dict[tuple[int, int], list[tuple[str, str]]] = {}
        todo = [(self.start, "")]
        while todo:
            p, done = todo.pop()
            rest = n - len(done)
            if rest < 0 or not self.lengths[p] >> rest & 1 and not self.lengths[p] >> (rest + 1) & 1:
                continue
            if len(done) <= last:
                if (p, rest) not in memo:
                    memo[p, rest] = self.edited(p, rest)
                for x, y in memo[p, rest]:
                    yield done + x, done + y
                todo += [(to, done + a) for a, to in self.arcs[p].items()]


def windows(vocab: DataFrame) -> DataFrame:
    """For each word its two classes and in each the halves in which an edit is looked for."""
    size = F.char_length("word")
    classes = F.explode(F.array(size, size - 1)).alias("c")
    rows = vocab.select("word", "n", classes).filter(F.col("c") >= LEAST_LENGTH)
    return rows.withColumns({"lo": F.lit(0), "hi": F.col("c")})


def halves(rows: DataFrame) -> DataFrame:
    """Each window cut in two, with the part of the word inside and the paths before and after it."""
    mid = ((F.col("lo") + F.col("hi")) / 2).cast("int")
    two = F.explode(F.array(F.struct("lo", mid.alias("hi")), F.struct(mid.alias("lo"), "hi"))).alias("w")
    cut = rows.select("word", "n", "c", two).select("word", "n", "c", "w.lo", "w.hi")
    size = F.char_length("word")
    tail = F.col("c") - F.col("hi")
    return cut.withColumns({
        "head": F.substr("word", F.lit(1), F.col("lo")),
        "inside": F.substr("word", F.col("lo") + 1, size - tail - F.col("lo")),
        "tail": F.substr("word", size - tail + 1, tail),
    })


KEY = ["c", "lo", "hi", "head", "tail"]


def near_words(vocab: DataFrame, most: int = WORDS) -> DataFrame:
    """(word, near, near_n): words one edit apart, in both directions, each pair once."""

    def enumerate_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            columns = zip(*rows)
            kinds = [pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "near", "near_n"])

        for batch in batches:
            found = []
            c, lo, hi, head, tail, words = (x.to_pylist() for x in batch.columns)
            for c, lo, hi, head, tail, words in zip(c, lo, hi, head, tail, words):
                n = {w["inside"]: w["n"] for w in words}
                for x, y in Acceptor(sorted(n)).pairs(hi - lo, hi - lo - (hi < c)):
                    one, two = head + x + tail, head + y + tail
                    found += [(one, two, n[y]), (two, one, n[x])]
                if len(found) >= 50_000:
                    yield out(found)
                    found = []
            if found:
                yield out(found)

    rows, pairs = halves(windows(vocab)), None
    while True:
        sizes = stored(rows.groupBy(*KEY).agg(F.count("*").alias("m")).filter("m > 1"), "sizes")
        hot = (F.col("m") > most) & (F.col("hi") - F.col("lo") > 1)
        members = rows.join(sizes, KEY)
        groups = members.filter(~hot).groupBy(*KEY).agg(F.collect_list(F.struct("inside", "n")).alias("words"))
        found = groups.mapInArrow(enumerate_pairs, "word string, near string, near_n long")
        pairs = found if pairs is None else pairs.unionByName(found)
        if sizes.filter(hot).isEmpty():
            return pairs
        rows = halves(stored(members.filter(hot).select("word", "n", "c", "lo", "hi"), "hot"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of the texts with the more frequent spelling that each is likely meant for.

    Words are runs of letters A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, of at least
    LEAST_LENGTH code points and LEAST_COUNT occurrences; one occurrence in SLIPS, chosen by
    a checksum of id (null: empty) and run, counts without one of its code points. Returns
    word, n, n_near (words one edit apart), form (of these the most frequent, ties: the
    smallest, if RATIO times as frequent; else null), form_n and root (where forms lead to
    from the word). Null and empty texts have no words; repeated rows count each; an empty
    table gives an empty result.
    """
    vocab = stored(vocabulary(docs, id_col, text_col), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    near = near_words(vocab).groupBy("word").agg(F.count("*").alias("n_near"), best)
    taken = -F.col("best.n") >= RATIO * F.col("n")
    words = stored(
        vocab.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.n")).alias("form_n"),
        ),
        "forms",
    )
    # A form is RATIO times as frequent as its word, so chains are short; each round doubles the steps taken.
    roots = words.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        roots = stored(roots, "roots")
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = roots.join(further, "root", "left")
        if joined.filter("beyond is not null").isEmpty():
            break
        roots = joined.select("word", F.coalesce("beyond", "root").alias("root"))
    return words.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
