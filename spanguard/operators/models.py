"""Model-based passes. The model is a parameter: a zero-argument factory that a
Python worker calls once per task and that returns a function from a list of texts
to what it finds in each, so that a real model can work in batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanguard.functions.bio import bio_decode
from spanguard.functions.spans import category_of, literal_map
from spanguard.functions.text import empty, finding
from spanguard.schema import CONTEXTUAL_LABELS, FINDINGS, TOKEN_SCORES

Span = tuple[str, int, int, float]
Score = tuple[int, int, list[float]]
Recognizer = Callable[[], Callable[[list[str]], list[list[Span]]]]
Scorer = Callable[[], Callable[[list[str]], list[list[Score]]]]


def each(fn: Callable[[str], list]) -> Callable[[list[str]], list[list]]:
    """A function of one text as one of many."""
    return lambda texts: [fn(t) for t in texts]


#: Characters of a call to a model, if all its texts were as long as its longest.
PADDED = 1 << 18


#: Characters of the texts whose findings a worker holds at a time, but for a longer text.
STEP = 1 << 18


def steps(batches: Iterator[pa.Array], most: int = STEP) -> Iterator[list[str | None]]:
    """The texts of the batches in lists of about `most` characters."""
    for batch in batches:
        start = size = 0
        for i, n in enumerate(pc.utf8_length(batch).to_pylist(), 1):
            size += n or 0
            if size >= most:
                yield batch[start:i].to_pylist()
                start, size = i, 0
        if start < len(batch) or not len(batch):
            yield batch[start:].to_pylist()


def by_length(texts: list[str], most: int = PADDED) -> list[list[int]]:
    """Places of the texts in calls of similar length, so that padding costs little."""
    calls: list[list[int]] = []
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        if calls and (len(calls[-1]) + 1) * len(texts[i]) <= most:
            calls[-1].append(i)
        else:
            calls.append([i])
    return calls


def windowed(scorer: Scorer, most: int = 128, overlap: int = 32) -> Scorer:
    """A scorer of texts of any length from one that takes at most `most` words at a time.

    A longer text is cut into windows of `most` words that share `overlap` words with the next
    one, each scored on its own; of the shared words the first half counts as the earlier
    window sees them, the second half as the later one does. Special tokens, with offsets
    (0, 0), stay at both ends of the text only.
    """
    if not 0 <= overlap < most:
        raise ValueError("the overlap must be shorter than a window")

    def make():
        fn, word = scorer(), re.compile(r"\S+")

        def pieces(text: str) -> list[tuple[int, int, int, int]]:
            """(first, last, kept from, kept before) of each window, in characters."""
            spans = [m.span() for m in word.finditer(text)]
            if len(spans) <= most:
                return [(0, len(text), 0, len(text) + 1)]
            out, at = [], 0
            while True:
                end = min(at + most, len(spans))
                low = spans[at + overlap // 2][0] if at else 0
                if end == len(spans):
                    return [*out, (spans[at][0], len(text), low, len(text) + 1)]
                following = at + most - overlap
                out.append((spans[at][0] if at else 0, spans[end - 1][1], low, spans[following + overlap // 2][0]))
                at = following

        def score(texts: list[str]) -> list[list[Score]]:
            cut = [(i, *p) for i, t in enumerate(texts) for p in pieces(t)]
            parts = [texts[i][a:b] for i, a, b, _, _ in cut]
            found: list = [None] * len(parts)
            for call in by_length(parts):
                for i, scores in zip(call, fn([parts[i] for i in call])):
                    found[i] = scores
            out: list[list[Score]] = [[] for _ in texts]
            for (i, a, b, low, high), scores in zip(cut, found):
                ends = low == 0, high > len(texts[i])  # the first and the last window
                for k, (start, end, logits) in enumerate(scores):
                    if (start, end) == (0, 0):
                        if ends[0] and k == 0 or ends[1] and k == len(scores) - 1:
                            out[i].append((0, 0, logits))
                    elif low <= start + a < high:
                        out[i].append((start + a, end + a, logits))
            return out

        return score

    return make


_SPAN = pa.struct(
    [
        ("label", pa.string()),
        ("start", pa.int32()),
        ("end", pa.int32()),
        ("score", pa.float64()),
    ]
)
_SCORE = pa.struct(
    [("start", pa.int32()), ("end", pa.int32()), ("logits", pa.list_(pa.float64()))]
)


def _with_model(
    df: DataFrame, text_col: str, out: str, factory, field: str, item: pa.StructType, ddl
) -> DataFrame:
    """Adds `out`: struct<`field`, error> from a function of many texts. Only the
    text crosses to Python, in Arrow batches. These are taken in steps of `STEP` characters, as
    what is found can be a hundred times larger than the texts; a step is handed on in calls of
    texts of similar length. A null text isn't handed on. If the
    function fails on a batch, its texts are tried one by one, and one that it
    fails on yields only the error.
    """
    keys = [item.field(i).name for i in range(item.num_fields)]

    def found_by_length(fn, texts: list[str]) -> list[tuple[list, str | None]]:
        out: list = [None] * len(texts)
        for call in by_length(texts):
            for i, found in zip(call, found_in(fn, [texts[i] for i in call])):
                out[i] = found
        return out

    def found_in(fn, texts: list[str]) -> list[tuple[list, str | None]]:
        try:
            return [([dict(zip(keys, x)) for x in found], None) for found in fn(texts)]
        except Exception as e:  # noqa: BLE001 - one bad text must not fail the job
            if len(texts) == 1:
                return [([], f"{type(e).__name__}: {e}")]
            return [found_in(fn, [t])[0] for t in texts]

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = factory()
        for texts in steps(batches):
            given = [t for t in texts if t is not None]
            got = iter(found_by_length(fn, given))
            values, errors = zip(*[next(got) if t is not None else ([], None) for t in texts]) if texts else ((), ())
            yield pa.StructArray.from_arrays(
                [pa.array(values, pa.list_(item)), pa.array(errors, pa.string())], names=[field, "error"]
            )

    apply.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    added = T.StructType().add(field, ddl).add("error", T.StringType())
    # Not deterministic, as far as Spark knows: so that it is never evaluated twice.
    model = F.arrow_udf(apply, added).asNondeterministic()
    return df.withColumn(out, model(F.col(text_col)))


def contextual_type(label: Column) -> Column:
    """Recogniser label to entity type; unknown labels are GENERIC_PII."""
    return F.coalesce(
        F.try_element_at(literal_map(dict(CONTEXTUAL_LABELS)), label),
        F.lit("GENERIC_PII"),
    )


def recognize(
    df: DataFrame, recognizer: Recognizer, text_col: str = "text", out: str = "recognized"
) -> DataFrame:
    """Adds struct<spans, error> of the recogniser."""
    ddl = T.ArrayType(T.StructType.fromDDL("label string, start int, end int, score double"))
    return _with_model(df, text_col, out, recognizer, "spans", _SPAN, ddl)


def contextual_findings(text: str, spans: str, name: str = "presidio") -> Column:
    """Recogniser spans as findings."""
    source = F.col(text)

    def convert(s):
        kind = contextual_type(s["label"])
        return finding(
            kind,
            s["start"],
            s["end"],
            source.substr(s["start"] + 1, s["end"] - s["start"]),
            s["score"],
            name,
            category_of(kind),
        )

    return F.coalesce(F.transform(F.col(spans), convert), empty(FINDINGS))


def score_tokens(
    df: DataFrame, scorer: Scorer, text_col: str = "text", out: str = "scored"
) -> DataFrame:
    """Adds struct<scores, error> of the classifier. The scorer gets the whole
    text and windows it as its model needs.
    """
    return _with_model(df, text_col, out, scorer, "scores", _SCORE, TOKEN_SCORES)


def semantic_findings(text: str, scores: str) -> Column:
    return F.coalesce(bio_decode(text, scores), empty(FINDINGS))


@dataclass(frozen=True)
class Detector:
    """A pass of the scan.

    `run(df, text_col, out)` adds a struct column `out` with an `error` field;
    `findings(text, out)` maps the two column names to an array of findings. A
    slow detector sees only texts the fast passes were not sure about.
    """

    name: str
    priority: int
    run: Callable[[DataFrame, str, str], DataFrame]
    findings: Callable[[str, str], Column]
    slow: bool = False


def contextual_detector(recognizer: Recognizer, name: str = "presidio") -> Detector:
    return Detector(
        name,
        2,
        lambda df, text, out: recognize(df, recognizer, text, out),
        lambda text, out: contextual_findings(text, f"{out}.spans", name),
    )


def semantic_detector(scorer: Scorer) -> Detector:
    return Detector(
        "semantic",
        3,
        lambda df, text, out: score_tokens(df, scorer, text, out),
        lambda text, out: semantic_findings(text, f"{out}.scores"),
        slow=True,
    )


def column_detector(
    name: str, priority: int, build: Callable[[str], Column], slow: bool = False
) -> Detector:
    """A pass made of built-in expressions only."""
    no_error = F.lit(None).cast("string").alias("error")
    return Detector(
        name,
        priority,
        lambda df, text, out: df.withColumn(
            out, F.struct(build(text).alias("found"), no_error)
        ),
        lambda text, out: F.coalesce(F.col(out)["found"], empty(FINDINGS)),
        slow,
    )
