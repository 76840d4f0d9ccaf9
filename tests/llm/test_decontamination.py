"""Items inside documents against brute force over all pairs."""

import random
import re

import pytest

from spanguard.llm.decontamination import contained_items

DOCS = "doc_id long, text string, item_id long, hash string, size string"
ITEMS = "item_id long, text string, n int"


def shingles(text, k):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, items, k=5, percent=80, short=False):
    out = []
    for d, text in docs:
        for i, item in items:
            q = shingles(item, k)
            inside = short and q and len(min(q)) < k
            x = shingles(text, len(min(q))) if inside else shingles(text, k)
            if q and 100 * len(q & x) >= percent * len(q):
                out.append((d, i, len(q & x), len(q)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, short", [(1, False), (2, True)])
def test_against_brute_force(spark, seed, short):
    r = random.Random(seed)

    def words(n):
        return [r.choice("abcdefgé") + str(r.randint(0, 90)) for _ in range(n)]

    items = [words(r.choice([1, 3, 5, 6, 12, 30, 70, 200])) for _ in range(20)]
    docs = []
    for _ in range(60):
        text = words(r.randint(0, 400))
        for item in r.sample(items, 2):
            part = list(item)
            for _ in range(r.randint(0, 1 + len(part) // 15)):
                part[r.randrange(len(part))] = "neu"
            at = r.randint(0, len(text))
            text[at:at] = part
        docs.append(r.choice([" ", ", ", "\n"]).join(text).upper())
    docs += [" ".join(items[0]), "", None, " ?! ", docs[3], docs[3]]
    doc_rows, item_rows = list(enumerate(docs)), [(100 + i, " ".join(x)) for i, x in enumerate(items)]
    item_rows += [(7, None), (8, ""), (9, item_rows[4][1]), (None, item_rows[5][1])]
    found = contained_items(
        spark.createDataFrame([(d, t, 5, "x", None) for d, t in doc_rows], DOCS).coalesce(1),
        spark.createDataFrame([(i, t, 0) for i, t in item_rows], ITEMS).coalesce(1),
        short_items=short,
    )
    got = [(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in found.collect()]
    assert sorted(got, key=str) == brute(doc_rows, item_rows, short=short)


def test_an_item_inside_a_very_long_text(spark):
    r = random.Random(3)
    text = [f"w{r.randint(0, 5000)}" for _ in range(60000)]
    items = [(1, " ".join(text[41000:41030])), (2, " ".join(text[59996:])), (3, "not in there at all"), (4, text[7])]
    docs = [(1, " ".join(text)), (2, " ".join(text[:41020]))]
    found = contained_items(
        spark.createDataFrame([(d, t, 0, "x", None) for d, t in docs], DOCS).coalesce(1),
        spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS).coalesce(1),
        short_items=True,
    )
    got = sorted((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in found.collect())
    assert got == [(1, 1, 26, 26), (1, 2, 1, 1), (1, 4, 1, 1), (2, 4, 1, 1)]


def test_without_rows(spark):
    some, none = spark.createDataFrame([(1, "a b c d e f", 2, "", "")], DOCS), spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "a b c d e f", 0)], ITEMS)
    assert contained_items(some, items).count() == 1
    assert contained_items(none, items).count() == 0
    assert contained_items(some, items.limit(0)).count() == 0


def test_large_sketches_are_not_broadcast(spark, monkeypatch):
    from spanguard.llm import decontamination

    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(1, "a b c d e f", 2, "", ""), (2, "x", 0, "", "")], DOCS)
    items = spark.createDataFrame([(1, "a b c d e f", 0)], ITEMS)
    assert [r.doc_id for r in contained_items(docs, items).collect()] == [1]


def test_short_items_inside_long_documents(spark):
    texts = ["one two three four five six seven", "three four", "four three two one zero six", "Six, SEVEN!", "", None, "x y three four five z q three four five"]
    items = ["three four five", "six", "four", "three four", "one two three four", "one two three four five six", "six one", " ?"]

    def runs(text):
        return [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]

    want = []
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            q, w = runs(item), runs(text)
            if 0 < len(q) < 5 and any(w[a : a + len(q)] == q for a in range(len(w))):
                want.append((d, i, 1, 1))
    want += [x for x in brute(list(enumerate(texts)), list(enumerate(items))) if len(runs(items[x[1]])) >= 5]
    docs = spark.createDataFrame([(d, t, 5, "x", None) for d, t in enumerate(texts)], DOCS).coalesce(1)
    tests = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], ITEMS).coalesce(1)
    found = contained_items(docs, tests, short_items=True).collect()
    assert sorted((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in found) == sorted(want)
