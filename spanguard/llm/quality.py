"""A quality score for whole texts, from a convolutional network over bytes.

Learned filters run over overlapping chunks that cover the whole text; their largest
responses in a chunk give the chunk's log odds. The mean, the least and the greatest
of these over all chunks are combined by a logistic function into one probability.
Both parts are trained on a bounded sample of labelled rows: the network on a few
chunks of each, the combination on all chunks, as they are scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanguard.llm.bytecnn import ByteConv, Shape, windows_of
from spanguard.llm.common import as_bytes, id_type, slices
from spanguard.llm.language_id import SLICE_BYTES, collect_windows, remainder, sampled

#: Labelled rows of each label to learn from, and chunks of each.
PER_LABEL = 1500
CHUNKS = 3
EPOCHS = 6
CUT = 0.3
SHAPE = Shape(window=512, widths=(2, 3, 5), filters=16)


def features(net: ByteConv, texts: list[bytes]) -> np.ndarray:
    """Mean (by bytes), least and greatest log odds over each text's chunks, and its size."""
    windows, counts, lengths = windows_of(texts, net.shape)
    logits = net.logits(windows).astype(np.float64)
    odds = logits[:, 1] - logits[:, 0]
    starts = np.cumsum(counts) - counts
    mean = np.add.reduceat(odds * lengths, starts) / np.add.reduceat(lengths, starts)
    size = np.log1p([len(t) for t in texts]) / 10
    return np.column_stack([mean, np.minimum.reduceat(odds, starts), np.maximum.reduceat(odds, starts), size, np.ones(len(texts))])


def logistic(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 30) -> np.ndarray:
    """Newton's method with a ridge; `share` is label 1's part of all labelled rows."""
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + w
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, slope)
    return w


class QualityModel:
    """Without a network, the score is label 1's share of the labelled rows for all."""

    def __init__(self, net: ByteConv | None, combine: np.ndarray | None, share: float):
        self.net, self.combine, self.share = net, combine, share

    def score(self, texts: list[bytes]) -> list[float]:
        if self.net is None:
            return [self.share] * len(texts)
        z = np.clip(features(self.net, texts) @ self.combine, -30, 30)
        return (1 / (1 + np.exp(-z))).tolist()


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_label: int = PER_LABEL,
    chunks: int = CHUNKS,
    epochs: int = EPOCHS,
) -> QualityModel:
    """Learn from the rows that `labels` marks 0 or 1; null ids and labels are ignored.

    An id drawn with both labels counts as 1.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    counts = {r.label: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return QualityModel(None, None, share)
    part = F.when(F.col("label") == 1, min(1.0, per_label / counts[1])).otherwise(min(1.0, per_label / counts[0]))
    drawn = marked.filter(sampled(F.col("id"), part)).collect()
    chosen = {r.id: r.label for r in sorted(drawn, key=lambda r: r.label)}
    texts = docs.filter(F.col(id_col).isin(list(chosen))).select(F.col(id_col).alias("label"), F.col(text_col).alias("text"))
    windows, ids = collect_windows(texts, chunks, SHAPE)
    target = np.array([chosen[i] for i in ids], int)
    if len(set(target)) < 2:
        return QualityModel(None, None, share)
    # The combination is fitted on rows that the network has not seen.
    held = np.array([hash_bit(i) for i in ids])
    net = ByteConv(2, SHAPE)
    if len(set(target[~held])) < 2 or len(set(target[held])) < 2:
        held = np.zeros(len(ids), bool)
    net.fit(windows[~held], target[~held], epochs)
    fitted_on = held if held.any() else np.ones(len(ids), bool)
    keys = sorted({i for i, f in zip(ids, fitted_on) if f}, key=str)
    fit_ids, rows = whole_features(texts.filter(F.col("label").isin(keys)), net)
    combine = logistic(rows, np.array([chosen[i] for i in fit_ids]), share)
    return QualityModel(net, combine, share)


def whole_features(texts: DataFrame, net: ByteConv) -> tuple[list, np.ndarray]:
    """Ids (column label) and `features` over all chunks of the rows, which must be few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE_BYTES):
            x = features(net, as_bytes(batch.column(1))).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    rows = texts.mapInArrow(run, f"label {id_type(texts, 'label')}, x array<double>").collect()
    rows.sort(key=lambda r: (str(r.label), r.x))
    return [r.label for r in rows], np.array([r.x for r in rows])


def hash_bit(key) -> bool:
    """A fixed quarter of all ids."""
    return (int(key) * 2654435761 >> 7) % 4 == 0 if isinstance(key, int) else zlib.crc32(str(key).encode()) % 4 == 0


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and score of each row; null and empty texts are scored as one empty chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE_BYTES):
            scores = model.score(as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type(docs, id_col)}, score double").withColumnRenamed("id", id_col)


def quality_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learned from labels whose remainder by 5 isn't 0."""
    model = train_quality(docs, labels.filter(remainder("doc_id", 5) != 0))
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return score_quality(docs, model).select(
        "doc_id", held_out, "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
