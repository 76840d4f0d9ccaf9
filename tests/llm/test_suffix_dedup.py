"""Suffix arrays and the removal of repeated strings, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanguard.llm.suffix_dedup import remove_repeats, removal_digest
from spanguard.llm.suffixes import permuted_common_prefixes, suffix_array

SCHEMA = "doc_id long, text string, content long, place string"


def brute(texts, span):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = [True] * span
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 4))
def test_suffix_array(symbols, repeat):
    symbols = symbols * repeat
    order = suffix_array(np.array(symbols))
    assert order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])
    common = permuted_common_prefixes(np.array(symbols), order)
    for a, b in zip(order, order[1:]):
        same = 0
        while max(a, b) + same < len(symbols) and symbols[a + same] == symbols[b + same]:
            same += 1
        assert common[b] == same


def fixture(seed):
    r = random.Random(seed)

    def words(n, alphabet="abcdeéß "):
        return "".join(r.choice(alphabet) for _ in range(n))

    passage, common = words(160), words(45)
    texts = [words(r.randint(0, 300)) for _ in range(12)]
    texts += [words(50) + passage[: r.randint(30, 160)] + words(40) for _ in range(8)]
    texts += [words(60) + common + words(60) for _ in range(15)]
    texts += [texts[3]] * 4 + ["a" * 90, "ab" * 60, "", None, "kurz", texts[5] + texts[5]]
    return texts


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"shard": 200}), (3, {"crowded": 3}), (4, {"crowded": 0, "gram": 7})])
def test_against_brute_force(spark, seed, options):
    texts = fixture(seed)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3, "doc_id")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/suffix-{seed}"
    docs.write.mode("overwrite").parquet(path)
    got = removal_digest(remove_repeats(spark.read.parquet(path), span=40, digest=True, **options)).collect()
    want = brute(texts, 40)
    assert {r.doc_id: tuple(r)[1:] for r in got} == dict(enumerate(want))


def test_edges(spark):
    text = "".join(chr(97 + (i * i) % 23) for i in range(700))
    rows = [(None, text, 1, "a"), (5, text, 1, "a"), (5, text, 1, "a"), (6, None, 1, None), (7, "", None, "")]
    got = removal_digest(remove_repeats(spark.createDataFrame(rows, SCHEMA).coalesce(1), digest=True)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted([tuple(r)[1:] for r in got]) == sorted([(700, 700, 1, empty)] * 3 + [(0, 0, 0, empty)] * 2)
    rows = [(5, text, 1, ""), (7, "", 1, ""), (8, "kurz", 1, "")]  # the first repeats itself
    kept = remove_repeats(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert {r.doc_id: bytes(r.kept) for r in kept} == {5: b"", 7: b"", 8: b"kurz"}
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_segment_of_copies_is_cut_once(spark, monkeypatch):
    from spanguard.llm import suffix_dedup

    r = random.Random(6)
    text, counts, stored = "".join(r.choice("abcdefg ") for _ in range(900)), {}, suffix_dedup.stored
    rows = [(i, text, 1, "x") for i in range(30)] + [(50, text[300:600], 1, "x")]
    docs = stored(spark.createDataFrame(rows, SCHEMA).repartition(4), "copies")
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, name: (out := stored(df, name), counts.update({name: out.count()}))[0])
    got = removal_digest(remove_repeats(docs, span=40, digest=True)).collect()
    assert {x.doc_id: tuple(x)[1:] for x in got} == dict(zip([x[0] for x in rows], brute([x[1] for x in rows], 40)))
    assert counts["segments"] < counts["anchors"] / 20
