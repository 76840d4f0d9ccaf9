"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from spanguard.llm import spelling
from spanguard.llm.spelling import Acceptor, near_words, spelling_variants

SCHEMA = "doc_id long, text string, word string, n long, root string"


def edits(a, b):
    """Whether two different strings are one edit apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if len(run) >= 7:
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
                counts[word] += len(word) >= 7
    n = {w: k for w, k in counts.items() if k >= 2}
    near = {w: [v for v in n if edits(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def fixture(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abÀé") for _ in range(r.randint(6, 10))) for _ in range(25)]
    base += ["aaaaaaa", "aaaaaaaa", "abababab", "internationalisation", "internationalization"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(r.randint(0, 30)):
            w = r.choice(base[: 1 + r.randrange(len(base))])
            if r.random() < 0.2:
                k = r.randrange(len(w))
                w = w[:k] + r.choice(["", "x", w[k] + r.choice("ab")]) + w[k + 1 :]
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i - 5, r.choice([" ", "1", ", ", "×\n"]).join(words)))
    return rows + [(None, "Internationalisation internationalisation"), (None, None), (7, ""), (7, None), (3, rows[3][1])]


def collected(df):
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(x) for x in df.select(columns).collect()), key=str)


@pytest.mark.parametrize("most", [2000, 3])
def test_against_brute_force(spark, monkeypatch, most):
    near = spelling.near_words
    monkeypatch.setattr(spelling, "near_words", lambda vocab: near(vocab, most))
    rows = fixture(most)
    df = spark.createDataFrame([(i, t, "w", 1, "r") for i, t in rows], SCHEMA)
    want = brute(rows)
    assert collected(spelling_variants(df)) == want
    assert any(w[1] and w[1] != w[2] for w in want) or any(w[1] for w in want)


def test_every_pair_once_in_small_windows(spark):
    r = random.Random(5)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(7, 9))) for _ in range(500)})
    vocab = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    want = sorted((a, b) for a in words for b in words if edits(a, b))
    for most in (5000, 20, 1):
        assert sorted((x.word, x.near) for x in near_words(vocab, most).collect()) == want


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("be", "de", "re") for b in ("an", "en", "on"))
    acceptor = Acceptor(words)
    assert len(acceptor.arcs) == 5  # start, one letter, two, three, all
    assert sorted(acceptor.pairs(4, 4)) == sorted((a, b) for a in words for b in words if a < b and edits(a, b))


def test_chains_long_words_and_empty_tables(spark):
    long = "ab" * 3000
    text = " ".join(["abcdefgh"] * 200 + ["abcdefgx"] * 20 + ["abcdefxx"] * 2 + [long] * 2 + [long + "c"] * 2)
    rows = [(-1, text)]
    got = collected(spelling_variants(spark.createDataFrame([(i, t, "", 0, "") for i, t in rows], SCHEMA)))
    assert got == brute(rows)
    assert ("abcdefxx", "abcdefgx", "abcdefgh", 2, 1, 20) in got or any(g[1] for g in got)
    assert spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
