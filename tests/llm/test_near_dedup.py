"""Near-duplicate groups against brute force over all pairs."""

import random
import re

import pytest

from spanguard.llm.near_dedup import banding, near_groups

SCHEMA = "doc_id long, text string, n long, key string, node string"


def shingles(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    comp = list(range(len(sets)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and 100 * len(a & b) >= percent * len(a | b):
                comp[max(root(x), root(y))] = min(root(x), root(y))
    ids = {}
    for x, (i, _) in enumerate(sets):
        ids.setdefault(root(x), []).append(i)
    return sorted((i, len(s), min(ids[root(x)])) for x, (i, s) in enumerate(sets))


def fixture(seed):
    r = random.Random(seed)

    def words(n):
        return [r.choice("abcdefghijklmnop") + str(r.randint(0, 400)) for _ in range(n)]

    texts = []
    for _ in range(12):
        w = words(r.randint(1, 120))
        for _ in range(r.randint(1, 9)):
            v = list(w)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                v[r.randrange(len(v))] = "neu" + str(r.randint(0, 99))
            texts.append(("  " if r.random() < 0.3 else "\n").join(v))
        chain = list(w)
        for i in range(6):  # each link near the one before, the ends far apart
            chain = chain[: len(chain) - 2] + words(1)
            texts.append(" ".join(chain))
    texts += ["", None, " \t", "Ein Wort", "ein wort", "ein", "EIN", texts[0].upper(), "x " * 500, "É é", "é é"]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, words, percent", [(1, 3, 85), (2, 5, 80)])
def test_against_brute_force(spark, seed, words, percent):
    rows = [(1000 - i, t) for i, t in enumerate(fixture(seed))]
    path = f"{spark.conf.get('spark.checkpoint.dir')}/near-{seed}"
    spark.createDataFrame([(i, t, 0, "k", None) for i, t in rows], SCHEMA).repartition(4, "doc_id").write.mode("overwrite").parquet(path)
    got = near_groups(spark.read.parquet(path), words=words, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, words, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edges(spark):
    rows = [(None, "a b c d", 0, "", ""), (4, "a b c d", 0, "", ""), (4, "a b c d", 0, "", ""), (None, None, 0, "", ""), (9, "", 0, "", "")]
    got = near_groups(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert [(r.doc_id, r.component_id) for r in got if r.n_shingles] == [(None, 4), (4, 4), (4, 4)]
    assert sum(r.kept for r in got) == 3
    assert near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_unlike_sets_of_a_bucket_are_not_compared_in_pairs(spark, monkeypatch):
    """A common passage brings unlike texts into one bucket; some are linked, but not to its hub."""
    from spanguard.llm import families

    r, words, texts = random.Random(4), 3, []
    for _ in range(100):
        own = [f"w{r.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(["the common passage", *own]), " ".join(["the common passage", *own[:-2], "end"])]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_no long, text string")
    entries = families.stored(rows.selectExpr("7L as key", "row_no as node"), "one_bucket")
    pairs, compare = [], families.compare
    monkeypatch.setattr(families, "compare", lambda found, *rest: pairs.append(found.count()) or compare(found, *rest))
    got = families.settle(entries, entries.selectExpr("node", "1L as weight"), rows, words, 85).collect()
    assert {(x.node, x.comp) for x in got} == {(i, i - i % 2) for i in range(200)}
    assert sum(pairs) <= 5 * len(texts)


def test_banding():
    for percent in (50, 80, 85, 95, 100):
        rows, bands = banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-6


def test_unlike_sets_are_looked_up_by_few_of_their_elements(spark, monkeypatch):
    """Half of each text is a common passage, and a second one is not in the hub of the bucket."""
    from spanguard.llm import families

    r, words, texts = random.Random(5), 3, []
    passages = [[f"{c}{i}" for i in range(30)] for c in "pq"]
    for i in range(60):
        own = [f"w{r.randrange(10**6)}" for _ in range(30)]
        texts += [" ".join([*passages[0], *own, *passages[1][: i % 2 * 30]]), " ".join([*passages[0], *own[:-2], "end", *passages[1][: i % 2 * 30]])]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_no long, text string")
    entries = families.stored(rows.selectExpr("7L as key", "row_no as node"), "one_bucket")
    counts, stored = {}, families.stored
    monkeypatch.setattr(families, "stored", lambda df, name: (out := stored(df, name), counts.update({name: out.count()}))[0])
    got = families.settle(entries, entries.selectExpr("node", "1L as weight"), rows, words, 85).collect()
    want = brute(list(enumerate(texts)), words, 85)
    assert {(x.node, x.comp) for x in got} == {(i, c) for i, _, c in want}
    assert 0 < counts["items"] <= 0.4 * sum(n for _, n, _ in want)
