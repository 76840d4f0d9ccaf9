"""The pipeline against a plain version of its filters."""

import random

import pytest
from pyspark.sql import functions as F
from test_decontamination import brute as contained
from test_near_dedup import brute as near

import corpus_pipeline
from spanguard.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int"
LANGUAGES = {"x": "abcd", "y": "öüäß"}


def fixture():
    r = random.Random(8)

    def text(lang, n):
        return " ".join("".join(r.choice(LANGUAGES[lang]) for _ in range(r.randint(3, 7))) for _ in range(n))

    items = [text("x", 30) for _ in range(4)]
    rows = []
    for i in range(70):
        lang = r.choice("xy")
        rows.append((i, text(lang, r.randint(20, 120)), lang))
    rows += [(100 + i, rows[i][1].upper().replace("SS", "ß") if i % 2 else rows[i][1], rows[i][2]) for i in range(10)]
    for i in range(10, 20):
        words = rows[i][1].split()
        words[len(words) // 2] = "anders"
        rows.append((200 + i, " ".join(words), rows[i][2]))
    rows += [(300 + i, f"{rows[30 + i][1]} {item} {rows[40 + i][1]}", "x") for i, item in enumerate(items)]
    rows += [(400, None, None), (401, "", "x"), (402, "12 34 !", None), (None, text("y", 60), None)]
    return rows, items


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_pipeline(spark, tmp_path):
    rows, items = fixture()
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, g, "s", len(t or ""), 1) for i, t, g in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [(i, t) for i, t, _ in rows if t and any(map(str.isalpha, t))]
    want = [{i for i, _ in kept}]
    last = {}
    for i, t in kept:
        last[lower(t)] = i if i is not None and (last.get(lower(t)) is None or i > last[lower(t)]) else last.get(lower(t), i)
    kept = [(i, t) for i, t in kept if last[lower(t)] == i]
    want.append({i for i, _ in kept})
    big = 10**9  # the null id, which is largest
    heads = {i for i, _, c in near([(big if i is None else i, t) for i, t in kept], 5, 80) if i == c}
    kept = [(i, t) for i, t in kept if (big if i is None else i) in heads]
    want.append({i for i, _ in kept})
    bad = {d for d, *_ in contained(kept, list(enumerate(items)))}
    kept = [(i, t) for i, t in kept if i not in bad]
    want.append({i for i, _ in kept})
    columns = docs.columns
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want):
        docs = stored(stage(spark, docs, folder), name)
        assert docs.columns == columns
        assert {r.doc_id for r in docs.select("doc_id").collect()} == ids, name
    assert len(want[0]) > len(want[1]) > len(want[2]) > len(want[3]) > 50
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in out.collect()} == want[-1]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_no_documents(spark, tmp_path, name):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0


def test_rows_pass_with_columns_of_any_name(spark, tmp_path):
    names = ["packed", "document", "lang_pred", "score", "row_no", "digit"]
    schema = SCHEMA + "".join(f", {n} array<string>" for n in names)
    texts = [None, "", "abc", "ABC", "é ab " * 400, "12"]
    rows = [(i, t, "x", "s", None, i, *[[str(i), None]] * len(names)) for i, t in enumerate(texts)]
    docs = stored(spark.createDataFrame(rows, schema).repartition(2), "any-names")
    left = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert left.schema == docs.schema and {r.doc_id for r in left.collect()} == {2, 3, 4}
    assert {tuple(r) for r in map(str, left.collect())} <= {tuple(r) for r in map(str, docs.collect())}
    once = corpus_pipeline.exact_dedup(spark, docs, str(tmp_path))
    assert once.columns == docs.columns and {r.doc_id: r.text for r in once.collect()} == {i: texts[i] for i in (1, 3, 4, 5)}
    none = corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), str(tmp_path))
    assert {r.doc_id for r in none.collect()} == {2, 3, 4}


def test_decontamination_runs_no_python(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "x one two three four five six y", "x", "s", 1, 1), (2, None, "x", "s", 1, 1), (3, "other words here", "x", "s", 1, 1)]
    docs = stored(spark.createDataFrame(rows, SCHEMA), "to-clean")
    left = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert {tuple(r) for r in left.collect()} == {tuple(rows[1]), tuple(rows[2])}
