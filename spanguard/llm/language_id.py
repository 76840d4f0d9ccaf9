"""Language identification with a convolutional network over bytes.

The network is trained on a bounded sample of labelled rows (`per_language` rows of
each language, fewer if there are many languages, `windows` windows of each, spread
over the whole text) and applied
to all windows of every text; a text's prediction comes from the mean of its
windows' log probabilities, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanguard.llm.bytecnn import ByteConv, Shape, log_softmax, spread_windows, windows_of
from spanguard.llm.common import ROW, as_bytes, id_type, row_number, slices

UNKNOWN = "und"
PER_LANGUAGE = 800
WINDOWS = 3
#: Labelled rows of all languages together to learn from, in expectation, shared evenly; but
#: `LEAST` of each language at least, so that none with labelled rows is left out.
TOTAL, LEAST = 51_200, 20
EPOCHS = 5
SLICE_BYTES = 1 << 19
SHAPE = Shape()
TENTHS = 1_000_000


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def sampled(key: Column, share: Column) -> Column:
    """True for about `share` of the keys, always the same ones."""
    h = F.xxhash64(key)
    finer = F.pmod(F.floor(h / TENTHS), F.lit(TENTHS)) / TENTHS
    return F.pmod(h, F.lit(TENTHS)) + finer < share * TENTHS


def collect_windows(labelled: DataFrame, n: int, shape: Shape) -> tuple[np.ndarray, list]:
    """Windows of the rows (label, text), which must be few, and the label of each."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(x, w) for x, d in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))) for w in spread_windows(d, n, shape)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in got], batch.schema.types[0]), pa.array([w for _, w in got], pa.binary())], ["label", "window"]
            )

    rows = labelled.mapInArrow(pick, f"label {id_type(labelled, 'label')}, window binary").collect()
    rows.sort(key=lambda r: (str(r.label), bytes(r.window)))
    return windows_of([bytes(r.window) for r in rows], shape)[0], [r.label for r in rows]


class LanguageModel:
    def __init__(self, languages: list[str], net: ByteConv | None):
        self.languages, self.net = languages, net

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        if not self.net:
            return [(UNKNOWN, 0.0)] * len(texts)
        windows, counts, lengths = windows_of(texts, self.net.shape)
        logs = log_softmax(self.net.logits(windows)).astype(np.float64) * lengths[:, None]
        starts = np.cumsum(counts) - counts
        mean = np.add.reduceat(logs, starts) / np.add.reduceat(lengths, starts)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [
            (self.languages[b], float(p[i, b])) if any(map(str.isalpha, t.decode())) else (UNKNOWN, 0.0)
            for i, (b, t) in enumerate(zip(best, texts))
        ]


def train_language(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    windows: int = WINDOWS,
    epochs: int = EPOCHS,
) -> LanguageModel:
    """Learn from the rows with a language and an id; without any, nothing is learned."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label"))
    rows = rows.filter("id is not null and label is not null and text is not null")
    counts = {r.label: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], None)
    quota = min(per_language, max(LEAST, TOTAL // len(languages)))
    parts = [F.lit(x) for name in languages if counts[name] > quota for x in (name, quota / counts[name])]
    share = F.coalesce(F.try_element_at(F.create_map(*parts), F.col("label")), F.lit(1.0)) if parts else F.lit(1.0)
    data, labels = collect_windows(rows.filter(sampled(F.col("id"), share)).select("label", "text"), windows, SHAPE)
    if not len(data):
        return LanguageModel([], None)
    net, place = ByteConv(len(languages), SHAPE), {name: i for i, name in enumerate(languages)}
    net.fit(data, np.array([place[x] for x in labels]), epochs)
    return LanguageModel(languages, net)


def predict_language(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """Id, lang_pred, score (0 to 1) and row number of each row.

    A null text, an empty one and one without a letter are `und` with score 0, as
    are all texts if nothing was learned. Repeated rows get the same prediction.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, SLICE_BYTES):
            got = model.predict(as_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())],
                [ROW, "id", "lang_pred", "score"],
            )

    rows = docs.select(row_number(row_col), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"{ROW} long, id {id_type(docs, id_col)}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", ROW)


def language_column(model: LanguageModel, text: Column) -> Column:
    """The lang_pred of `predict_language` as a column: rows keep all their columns, and nothing is joined."""

    @F.arrow_udf("string")
    def language(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        got = [x for part in slices(iter([batch]), 0, SLICE_BYTES) for x, _ in model.predict(as_bytes(part.column(0)))]
        return pa.array(got, pa.string())

    return language(text)


def language_of_documents(docs: DataFrame, row_col: str | None = None) -> DataFrame:
    """Predictions for all documents, learned from those whose remainder by 3 isn't 1."""
    model = train_language(docs.filter(remainder("doc_id", 3) != 1))
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return predict_language(docs, model, row_col=row_col).select("doc_id", held_out, "lang_pred", "score", ROW)
