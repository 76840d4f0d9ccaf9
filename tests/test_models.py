"""Model passes, the short-circuit and failures."""

import math
import random
import re
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanguard.functions import bio as B
from spanguard.operators import models as M
from spanguard.operators import scan as S
from spanguard.schema import BIO_LABELS, TOKEN_SCORES


# Workers cannot import the test module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def names():
    def recognise(text):
        if "boom" in text:
            raise ValueError("boom")
        return [("PERSON", m.start(), m.end(), 0.85) for m in re.finditer(r"[A-Z]\w+ [A-Z]\w+", text)]

    return M.each(recognise)


def secrets():
    def score(text):
        # The special first token carries a wrong offset-free label.
        out = [(0, 0, [9.0, 0.0, 0.0, 0.0, 0.0])]
        for m in re.finditer(r"\S+", text):
            label = 3 if m.group() == "hunter2" else 0
            out.append((m.start(), m.end(), [5.0 if i == label else 0.0 for i in range(5)]))
        return out

    return M.each(score)


def test_passes_merge_and_short_circuit(spark):
    texts = ["John Smith says hunter2", "boom John Smith", "a@b.co hunter2", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = S.scan(df, detectors=[M.contextual_detector(names), M.semantic_detector(secrets)])
    rows = {r.id: r for r in out.collect()}
    assert [(f.entity_type, f.detector) for f in rows[0].findings] == [
        ("PERSON_NAME", "presidio"),
        ("GENERIC_SECRET", "semantic"),
    ]
    assert rows[0].redacted_text == "[REDACTED_NAME] says [REDACTED_SECRET]"
    assert (rows[1].detector_errors, rows[1].findings) == (1, [])
    # The e-mail address is conclusive, so the classifier never saw the secret.
    assert [f.detector for f in rows[2].findings] == ["regex"]
    assert rows[3].findings == []
    assert rows[0].detectors_used == ["regex", "presidio", "semantic"]


def test_names_alone_do_not_skip_the_classifier(spark):
    df = spark.createDataFrame([("John Smith uses hunter2",)], "text string")
    out = S.scan(df, detectors=[M.contextual_detector(names), M.semantic_detector(secrets)])
    assert {f.detector for f in out.first().findings} == {"presidio", "semantic"}


def test_built_in_detector(spark, finding):
    def ticket(text):
        return F.expr(
            f"if(contains({text}, 'TICKET'), array(named_struct('entity_type', 'GENERIC_PII',"
            " 'category', 'PII', 'start', 0, 'end', 6, 'matched_text', 'TICKET', 'confidence', 0.9D,"
            " 'detector', 'ticket')), null)"
        )

    df = spark.createDataFrame([("TICKET 1",), ("none",)], "text string")
    out = S.scan(df, detectors=[M.column_detector("ticket", 4, ticket)]).collect()
    assert [r.redacted_text for r in out] == ["[REDACTED_PII] 1", "none"]


def test_unknown_recogniser_label_is_generic(spark):
    df = spark.createDataFrame([("PERSON",), ("NRP",)], "l string")
    got = [r[0] for r in df.select(M.contextual_type(F.col("l"))).collect()]
    assert got == ["PERSON_NAME", "GENERIC_PII"]


def decode(scores):
    out, current = [], None

    def flush():
        nonlocal current
        if current:
            label, start, end, probs = current
            out.append((label, start, end, round(sum(probs) / len(probs), 4)))
        current = None

    for i, (start, end, logits) in enumerate(scores):
        top = max(logits)
        prob = 1 / sum(math.exp(x - top) for x in logits)
        label = BIO_LABELS[logits.index(top)]
        if start == end == 0 and i > 0 or label == "O":
            flush()
        elif label.startswith("B-"):
            flush()
            current = [label[2:], start, end, [prob]]
        elif current:
            current[2] = end
            current[3].append(prob)
    flush()
    return out


def test_decode_random_scores(spark):
    rng = random.Random(2)
    cases = []
    for i in range(500):
        scores, pos = [], 0
        for _ in range(rng.randint(0, 12)):
            start, end = (0, 0) if rng.random() < 0.15 else (pos, pos + rng.randint(1, 4))
            pos = max(pos, end + 1)
            scores.append((start, end, [rng.gauss(0, 1.5) for _ in range(5)]))
        cases.append((i, "x" * 80, scores))
    schema = T.StructType.fromDDL("i int, text string").add("s", TOKEN_SCORES)
    rows = spark.createDataFrame(cases, schema).select("i", B.bio_decode("text", "s").alias("f"))
    kind = {"GENERIC_PII": "PII", "GENERIC_SECRET": "SECRET"}
    for r in rows.collect():
        got = [(kind[f.entity_type], f.start, f.end, f.confidence) for f in r.f]
        assert got == decode(cases[r.i][2])


def walk(text, entities):
    tags = ["O"] * len(text)
    for start, end, label in sorted(entities, key=lambda e: e[0]):
        for i in range(start, min(max(end, start + 1), len(text))):
            tags[i] = ("B-" if i == start else "I-") + label
    out, pos = [], 0
    for token in text.split():
        while pos < len(text) and text[pos] == " ":
            pos += 1
        out.append(tags[pos] if pos < len(tags) else "O")
        pos += len(token)
    return text.split(), out


def test_text_to_bio_random_texts(spark):
    rng = random.Random(4)
    cases = []
    for i in range(600):
        text = "".join(rng.choice("ab  \n\té ") for _ in range(rng.randint(0, 40)))
        starts = [rng.randint(0, 40) for _ in range(rng.randint(0, 4))]
        entities = [(s, s + rng.randint(0, 8), rng.choice(["PII", "SECRET"])) for s in starts]
        cases.append((i, text, entities))
    cases.append((600, "word \n" * 1500, [(5, 9, "PII"), (3000, 3003, "SECRET")]))
    df = spark.createDataFrame(
        cases, "i int, text string, entities array<struct<start:int,end:int,label:string>>"
    )
    rows = df.select("i", B.bio_tokens("text").alias("t"), B.text_to_bio("text", "entities").alias("g"))
    for r in rows.collect():
        assert (r.t, r.g) == walk(*cases[r.i][1:])


def test_align_subwords(spark):
    df = spark.createDataFrame(
        [([1, 0, 3], [None, 0, 0, 1, 2, 2, 7, None])], "labels array<int>, words array<int>"
    )
    got = df.select(B.align_subwords("labels", "words", 10)).first()[0]
    assert got == [-100, 1, 2, 0, 3, 4, 0, -100, -100, -100]


def test_encode_unknown_label_is_o(spark):
    df = spark.createDataFrame([(["O", "B-SECRET", "X"],)], "t array<string>")
    assert df.select(B.encode_labels("t")).first()[0] == [0, 3, 0]


def test_registered_bio_queries_on_given_texts(spark, sf):
    from collections import Counter

    from spanguard.plans import catalog, scoring

    got = {name: catalog.QUERIES[name](spark, sf).collect() for name in ("text_to_bio", "encode_labels", "label_distribution")}
    rows, counts, broken = [], Counter(), 0
    for r in scoring.labeled_documents(spark, sf).collect():
        tokens, tags = walk(r.text, [(e.start, e.end, e.label) for e in r.entities])
        rows += [(r.doc_id, i, *x) for i, x in enumerate(zip(tokens, tags)) if x[1] != "O"]
        counts.update(tags)
        broken += "\n" in r.text
    assert broken > 50 and sorted(tuple(r) for r in got["text_to_bio"]) == sorted(rows)
    ids = ["O", "B-PII", "I-PII", "B-SECRET", "I-SECRET"]
    assert {r.label: r.n for r in got["encode_labels"]} == {ids.index(t): n for t, n in counts.items()}
    assert {r.label: r.n for r in got["label_distribution"]} == dict(counts)


def test_windows_are_stitched_to_the_scores_of_the_whole():
    from spanguard.plans.detection import short_scorer, stub_scorer

    rng = random.Random(3)
    words = ["a", "b1", "22", "averyverylongword", "xyz", "extraordinarilylong"]
    texts = ["", " ", "one"] + [
        rng.choice(["", " "]) + rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.choice([3, 127, 128, 129, 224, 225, 700]))) for _ in range(60)
    ]
    want = stub_scorer()(texts)
    assert M.windowed(short_scorer, 128, 32)()(texts) == want
    assert M.windowed(short_scorer, 9, 4)()(texts) == want


def test_calls_hold_texts_of_similar_length():
    rng = random.Random(4)
    texts = ["x" * rng.randint(0, 500) for _ in range(300)] + ["y" * 5000]
    calls = M.by_length(texts, 4000)
    assert sorted(i for c in calls for i in c) == list(range(301))
    assert all(len(c) == 1 or len(c) * max(len(texts[i]) for i in c) <= 4000 for c in calls)


def test_texts_are_taken_in_steps():
    import pyarrow as pa

    batches = [["a" * 30, None, "é" * 80, "b"] * 5, [], [None], ["c" * 500, "d"]]
    got = list(M.steps(iter([pa.array(b, pa.string()) for b in batches]), 100))
    assert [t for step in got for t in step] == [t for b in batches for t in b]
    assert all(sum(len(t or "") for t in step[:-1]) < 100 for step in got)


def test_passes_over_several_steps_keep_the_order(spark):
    texts = [None if i % 7 == 3 else f"hunter2 {i} " + "x " * (40_000 if i % 5 == 0 else 3) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    for r in M.score_tokens(df, secrets).collect():
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", texts[r.id] or "")]
        assert [(s.start, s.end) for s in r.scored.scores] == ([(0, 0), *words] if texts[r.id] else [])


def test_tags_are_built_once_per_text(spark, sf):
    from spanguard.plans import catalog

    for name in ("encode_labels", "label_distribution"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("_tag_batches(") == 1


def test_tags_of_incomplete_spans(spark):
    cases = [
        ("one two three", [(4, None, "PII"), None, (None, 3, "SECRET"), (8, 9, None)], ["I-SECRET", "B-PII", None]),
        ("one two", None, ["O", "O"]),
        ("one two", [(3, 5, "PII"), (3, 7, "SECRET")], ["O", "I-SECRET"]),
        ("", [(0, 1, "PII")], []),
        (None, [(0, 1, "PII")], None),
    ]
    df = spark.createDataFrame(
        [(i, *c[:2]) for i, c in enumerate(cases)], "i int, text string, entities array<struct<start:int,end:int,label:string>>"
    )
    rows = df.select("i", B.text_to_bio("text", "entities").alias("g")).collect()
    assert {r.i: r.g for r in rows} == {i: c[2] for i, c in enumerate(cases)}
