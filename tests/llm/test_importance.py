"""Importance resampling against plain counting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spanguard.llm import importance
from spanguard.llm.importance import Weigher, resample

SCHEMA = "doc_id long, text string, rank long, place string, part long"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), Counter(zlib.crc32(x.encode()) % 10000 for x in runs)


def brute(rows, target):
    found = [(i, *buckets(t)) for i, t in rows]
    corpus, aim = Counter(), Counter()
    for _, _, c in found:
        corpus += c
    for t in target:
        aim += buckets(t)[1]
    s_all, t_all = corpus.total() + 10000, aim.total() + 10000
    gain = [math.floor(1000 * math.log((aim[b] + 1) * s_all / ((corpus[b] + 1) * t_all))) for b in range(10000)]
    out = []
    for i, words, c in found:
        weight = sum(gain[b] * n for b, n in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, words, c.total(), weight, score, None])
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0]))
    for place, row in enumerate(able[: 5 * len(able) // 100], 1):
        row[5] = place
    return sorted((tuple(x) for x in out), key=str)


def fixture():
    r = random.Random(3)
    vocabulary = ["Wort", "über", "x1", "THE", "a", "quality", "日本", "z" * 60, "é" * 40, "q" * 700]

    def text(n):
        return r.choice([" ", ", ", "-\n"]).join(r.choice(vocabulary) + str(r.randint(0, 9)) * r.randint(0, 1) for _ in range(n))

    rows = [(900 - i, text(r.randint(0, 60))) for i in range(400)]
    rows += [(5, None), (6, ""), (7, " .,"), (None, text(30)), (None, None), rows[3], rows[3], (2000, text(3000))]
    return rows, [text(20) for _ in range(5)] + [None, ""]


def run(spark, rows, target):
    docs = spark.createDataFrame([(i, t, 0, "p", 1) for i, t in rows], SCHEMA).repartition(3)
    got = resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    got = got.select("doc_id", "n_words", "n_features", "weight", "score", "rank")
    return sorted((tuple(x) for x in got.collect()), key=str)


@pytest.mark.parametrize("block", [1 << 17, 11])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(importance, "BLOCK", block)
    rows, target = fixture()
    got, want = run(spark, rows, target), brute(rows, target)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert sum(g[5] is not None for g in got) == sum(w[5] is not None for w in want) > 10
    repeated = rows[3][0]
    assert [g for g in got if g[0] != repeated] == [w for w in want if w[0] != repeated]


def test_empty_tables(spark):
    rows, _ = fixture()
    assert run(spark, [], ["a b"]) == []
    assert run(spark, rows[:50], []) == brute(rows[:50], [])


def test_weights_are_sums():
    r = np.random.Generator(np.random.PCG64(4))
    for least, most in ((-8192, 8191), (-1, 0), (0, 0), (5, 900), (-70000, 3)):
        gain = r.integers(least, most + 1, 10000)
        counts = r.poisson(0.4, (5, 10000)) * r.integers(0, 300, (5, 10000))
        assert (Weigher(gain)(counts) == counts @ gain).all()


def test_checksums_of_joined_strings():
    a, b = b"some words ", b"z" * 100_000
    for n in (0, 1, 63, 64, 65, 4096, 100_000):
        crcs = [np.array([zlib.crc32(x)], np.uint32) for x in (a, b[:n])]
        assert importance.joined(*crcs, np.array([n]))[0] == zlib.crc32(a + b[:n])
