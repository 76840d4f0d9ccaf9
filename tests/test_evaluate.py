"""Scores, splits and synthesis."""

import random

import pytest
from pyspark.sql import functions as F

from spanguard.operators import dataset as G
from spanguard.operators import evaluate as E
from spanguard.schema import BIO_LABELS
from spanguard.sources import tables


def overlap(g, p):
    inter = max(0, min(g[1], p[1]) - max(g[0], p[0]))
    union = max(g[1], p[1]) - min(g[0], p[0])
    return union > 0 and inter / union >= 0.5


def two_passes(gold, pred):
    used, hit, out = set(), {}, []
    for i, g in enumerate(gold):
        for j, p in enumerate(pred):
            if j not in used and p[2] == g[2] and overlap(g, p):
                used.add(j)
                hit[i] = j
                break
    for i, g in enumerate(gold):
        if i in hit:
            out.append((g[2], g[2], pred[hit[i]][3]))
            continue
        wrong = next((j for j, p in enumerate(pred) if j not in used and overlap(g, p)), None)
        used |= {wrong} - {None}
        out.append((g[2], "NONE" if wrong is None else pred[wrong][2], None))
    out += [("NONE", p[2], None) for j, p in enumerate(pred) if j not in used]
    return out or [("NONE", "NONE", None)]


def test_match_random_cases(spark):
    rng = random.Random(9)
    span = lambda: (s := rng.randint(0, 12), s + rng.randint(0, 6))
    cases = []
    for i in range(600):
        gold = [(*span(), rng.choice(E.CATEGORIES)) for _ in range(rng.randint(0, 5))]
        pred = [(*span(), rng.choice(E.CATEGORIES), rng.choice("xyz")) for _ in range(rng.randint(0, 5))]
        cases.append((i, gold, pred))
    df = spark.createDataFrame(
        cases,
        "i int, gold array<struct<start:int,end:int,label:string>>,"
        " pred array<struct<start:int,end:int,category:string,entity_type:string>>",
    )
    rows = df.select("i", E.match_outcomes("gold", "pred").alias("o")).collect()
    for r in rows:
        assert [tuple(o) for o in r.o] == two_passes(*cases[r.i][1:]), cases[r.i]


def test_match_many_spans(spark):
    rng = random.Random(10)
    cases = []
    for i, spread in enumerate((100, 400, 3000)):
        span = lambda: (s := rng.randint(0, spread), s + rng.randint(0, 30))  # noqa: B023, E731
        gold = [(*span(), rng.choice(E.CATEGORIES)) for _ in range(200)]
        cases.append((i, gold, [(*span(), rng.choice(E.CATEGORIES), rng.choice("xyz")) for _ in range(150)]))
    df = spark.createDataFrame(
        cases,
        "i int, gold array<struct<start:int,end:int,label:string>>,"
        " pred array<struct<start:int,end:int,category:string,entity_type:string>>",
    )
    for r in df.select("i", E.match_outcomes("gold", "pred").alias("o")).collect():
        assert [tuple(o) for o in r.o] == two_passes(*cases[r.i][1:])


def test_scores(spark):
    rows = [("PII", "PII", "EMAIL")] * 3 + [("PII", "NONE", None), ("SECRET", "PII", None)]
    rows += [("NONE", "NONE", None)]
    df = spark.createDataFrame(rows, "gold string, pred string, pred_type string")
    got = {r.category: r for r in E.prf(df).collect()}
    assert (got["PII"].precision, got["PII"].recall, got["PII"].f1) == (0.75, 0.75, 0.75)
    assert (got["SECRET"].precision, got["SECRET"].recall, got["SECRET"].f1) == (0.0, 0.0, 0.0)
    assert (got["micro"].tp, got["micro"].fp, got["micro"].fn) == (3, 1, 2)
    cells = {(r.gold, r.pred): r.n for r in E.confusion(df).collect()}
    assert len(cells) == 9 and cells["SECRET", "PII"] == 1 and cells["NONE", "NONE"] == 1
    assert [tuple(r) for r in E.tp_type_breakdown(df).collect()] == [("EMAIL", 3)]


def chunks(tags):
    out, start, kind = set(), None, None
    for i, tag in enumerate([*tags, "O"]):
        here = tag[2:]
        if start is not None and (tag == "O" or tag[0] == "B" or here != kind):
            out.add((kind, start, i))
            start = None
        if tag != "O" and start is None:
            start = i
        kind = here
    return out


def test_entity_scores_random(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        n = rng.randint(0, 12)
        true = [rng.choice([-100, 0, 0, 1, 2, 3, 4]) for _ in range(n)]
        rows.append((i, true, [t if t >= 0 and rng.random() < 0.7 else rng.randint(0, 4) for t in true]))
    tp = fp = fn = 0
    for _, true, pred in rows:
        keep = [(BIO_LABELS[t], BIO_LABELS[p]) for t, p in zip(true, pred) if t != -100]
        a, b = chunks([t for t, _ in keep]), chunks([p for _, p in keep])
        tp, fp, fn = tp + len(a & b), fp + len(b - a), fn + len(a - b)
    df = spark.createDataFrame(rows, "i int, true array<int>, pred array<int>")
    got = {r.label: r for r in E.entity_prf(df).collect()}["micro"]
    assert (got.tp, got.fp, got.fn) == (tp, fp, fn)
    assert got.precision == pytest.approx(tp / (tp + fp), abs=1e-4)


def test_label_distribution_skips_ignored(spark):
    df = spark.createDataFrame([([0, 0, 1, -100],), ([0],)], "labels array<int>")
    got = {r.label: (r.n, r.pct) for r in E.label_distribution(df).collect()}
    assert got == {"O": (3, 75.0), "B-PII": (1, 25.0)}


@pytest.mark.parametrize("n", [1, 5, 12, 35, 1000])
def test_split_sizes(spark, n):
    import math

    df = G.split_80_10_10(spark.range(n), "id")
    got = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    held = math.ceil(0.2 * n)
    test = math.ceil(0.5 * held)
    want = {"test": test, "validation": held - test, "train": n - held}
    assert got == {k: v for k, v in want.items() if v}
    again = G.split_80_10_10(spark.range(n).repartition(3), "id")
    assert sorted(df.collect()) == sorted(again.collect())


def test_synthetic_spans(spark):
    df = G.synthesize(spark.range(2000), "id")
    assert df.filter(~G.verify_spans()).count() == 0
    assert {r.family for r in df.select("family").distinct().collect()} == {f for f, _ in G.FAMILIES}
    ssn = df.filter("family = 'ssn'").first()
    span = ssn.entities[0]
    words = ssn.text[span.start : span.end].split()
    assert len(words) == 11 and set(words) <= {*G.DIGIT_WORDS, "dash"}


def test_blank_span_is_invalid(spark):
    df = spark.createDataFrame(
        [("a  b", [(1, 3, "PII")])],
        "text string, entities array<struct<start:int,end:int,label:string>>",
    )
    assert df.select(G.verify_spans()).first()[0] is False


def test_labeled_files(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    lines = [f'{{"text": "n{i}", "entities": []}}' for i in range(100)]
    path.write_text("\n\n".join(lines))
    df = tables.read_labeled(spark, str(path))
    kept = G.cap_negatives(df, 80).collect()
    assert [r.text for r in kept] == [f"n{i}" for i in range(80)]


def test_parity(spark):
    schema = (
        "id int, scores array<struct<start:int,end:int,logits:array<double>>>,"
        " findings array<struct<category:string,start:int,end:int>>"
    )
    a = [(1, [(0, 1, [1.0, 2.0])], [("PII", 0, 1)]), (2, [(0, 1, [1.0, 2.0])], [])]
    b = [(1, [(0, 1, [1.0, 2.00001])], [("PII", 0, 1)]), (2, [(0, 1, [2.0, 1.0])], [("PII", 0, 1)])]
    compared = E.parity(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "id")
    got = {r.id: r for r in compared.collect()}
    assert not got[1].argmax_differs and not got[1].spans_differ
    assert got[2].argmax_differs and got[2].spans_differ
    total = E.parity_summary(compared.filter(F.col("id") == 1)).first()
    assert (total.within_tolerance, total.argmax_mismatches) == (True, 0)
