"""PartEnum groups against brute force over all pairs."""

import random

import numpy as np
import pytest
from test_near_dedup import SCHEMA, brute, fixture

from spanguard.llm import families, jaccard_join
from spanguard.llm.jaccard_join import LEVELS, PartEnum, jaccard_groups


def groups(spark, rows, name, **options):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/jaccard-{name}"
    spark.createDataFrame([(i, t, 0, "k", None) for i, t in rows], SCHEMA).repartition(4, "doc_id").write.mode("overwrite").parquet(path)
    got = jaccard_groups(spark.read.parquet(path), **options).collect()
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in got)


@pytest.mark.parametrize("seed, words, percent", [(1, 5, 80), (2, 3, 85), (3, 2, 60)])
def test_against_brute_force(spark, seed, words, percent):
    rows = [(1000 - i, t) for i, t in enumerate(fixture(seed))]
    assert groups(spark, rows, seed, words=words, percent=percent) == brute(rows, words, percent)


def family(r, n, words, changes, versions=1):
    """Copies of a text, or of versions of it, each with places of its own."""
    hub = [f"w{r.randint(0, 10**6)}" for _ in range(words)]
    texts = []
    for i in range(n):
        v = list(hub)
        for k in range(i % versions):
            v[7 * k % words] = f"version{k}"
            v[(7 * k + 3) % words] = f"also{k}"
        for _ in range(r.randint(*changes)):
            v[r.randrange(words)] = f"new{r.randint(0, 10**6)}"
        texts.append(" ".join(v))
    return texts


@pytest.mark.parametrize("changes, versions", [((1, 4), 1), ((2, 3), 1), ((0, 2), 6), ((3, 6), 2)])
def test_families(spark, changes, versions):
    r = random.Random(sum(changes) + versions)
    texts = family(r, 150, 120, changes, versions) + family(r, 40, 60, (1, 2))
    rows = [(i, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    assert groups(spark, rows, f"family-{changes[0]}-{versions}") == brute(rows, 5, 80)


def test_few_pairs_of_a_family_are_compared(spark, monkeypatch):
    sizes = []
    compare = families.compare

    def counted(pairs, *rest):
        found = compare(pairs, *rest)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(families, "compare", counted)
    texts = family(random.Random(9), 300, 120, (2, 3))
    rows = list(enumerate(texts))
    assert groups(spark, rows, "few") == brute(rows, 5, 80)
    assert sum(sizes) < 10 * len(rows)


def test_linked_sets_share_signatures():
    r = np.random.Generator(np.random.PCG64(1))
    partenum = PartEnum(80)
    for n in (4, 5, 6, 9, 17, 44, 45, 170, 900):
        for _ in range(20):
            a = np.unique(r.integers(0, 2**63, n, np.uint64))
            for drop in range(0, n // 5 + 1, max(1, n // 20)):
                for add in (0, max(0, (n - drop) - 4 * drop) // 4):
                    b = np.unique(np.append(a[drop:], r.integers(0, 2**63, add, np.uint64)))
                    both = len(np.intersect1d(a, b))
                    if 100 * both < 80 * (len(a) + len(b) - both) or len(a) == len(b) == both:
                        continue
                    found = [partenum.signatures([a, b], which) for which in (0, 1)]
                    sides = [set().union(*({*k[of == i].tolist()} for of, k, *_ in found)) for i in (0, 1)]
                    assert sides[0] & sides[1]


def test_sets_in_few_partitions_meet_at_last(monkeypatch):
    monkeypatch.setattr(jaccard_join, "mixed", lambda a, b: a + np.uint64(0) * b)  # all in one partition, at all levels
    a, b = np.arange(1, 11, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    of, _, level, used, k = PartEnum(80).signatures([a, b], 0)
    assert (used <= k[:, None]).all() and level.max() == LEVELS


def test_edges(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "A b c  d"), (None, None), (9, ""), (8, " \t")]
    assert groups(spark, [r for r in rows if r[0] is not None], "edges") == brute([r for r in rows if r[0] is not None], 5, 80)
    got = jaccard_groups(spark.createDataFrame([(i, t, 0, "", "") for i, t in rows], SCHEMA).coalesce(1)).collect()
    assert [r.component_id for r in got if r.n_shingles] == [4, 4, 4]
    assert jaccard_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(f"w{i % 7919}x{i % 31}" for i in range(60_000))
    assert {r[2] for r in groups(spark, [(5, long), (3, long + " more"), (4, "w0x0 w1x1 w2x2 w3x3 w4x4")], "long")} == {3, 4}
