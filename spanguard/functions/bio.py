"""Helpers for BIO sequences: decode, encode, align, chunks. Arguments are SQL
expression text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanguard.functions.spans import map_sql
from spanguard.functions.text import round_exact_sql, sql_let
from spanguard.schema import (
    BIO_LABELS,
    CATEGORY_OF,
    IGNORE_LABEL,
    MAX_TOKENS,
    SEMANTIC_LABELS,
)

# What Python's str.split() splits on.
_SPACES = r"r'[\s\x1c-\x1f\x85\p{Z}]+'"
_LABELS = "array(" + ", ".join(f"'{b}'" for b in BIO_LABELS) + ")"


def semantic_type_sql(label: str) -> str:
    """PII / SECRET to a generic entity type; anything else is GENERIC_PII."""
    known = map_sql(dict(SEMANTIC_LABELS))
    return f"coalesce(try_element_at({known}, {label}), 'GENERIC_PII')"


def semantic_type(label: str) -> Column:
    return F.expr(semantic_type_sql(label))


def _runs(size: str, opens: str, breaks: str) -> str:
    """Half-open index ranges (lo, hi) that start where `opens` holds and end
    before the next index where `breaks` holds. Both are predicates of `i`, and
    every opening index has to be a break.
    """
    cuts = f"filter(sequence(0, {size} - 1), i -> {breaks})"
    ranges = f"transform(cs, (c, j) -> struct(c as lo, coalesce(get(cs, j + 1), {size}) as hi))"
    opened = f"filter({ranges}, r -> {sql_let('i', 'r.lo', opens)})"
    return (
        f"if({size} > 0, {sql_let('cs', cuts, opened)},"
        " cast(array() as array<struct<lo:int,hi:int>>))"
    )


def token_predictions_sql(scores: str) -> str:
    """Label and probability of the best logit of each token; a (0, 0) offset
    after the first token is special and carries no label.
    """
    total = "aggregate(t.logits, 0D, (acc, x) -> acc + exp(x - array_max(t.logits)))"
    best = f"{_LABELS}[cast(array_position(t.logits, array_max(t.logits)) as int) - 1]"
    return (
        f"transform({scores}, (t, i) -> struct(t.start as start, t.end as end,"
        f" if(i > 0 and t.start = 0 and t.end = 0, 'O', {best}) as label,"
        f" 1D / {total} as prob))"
    )


def token_predictions(scores: str) -> Column:
    return F.expr(token_predictions_sql(scores))


def span_confidence_sql(probs: str) -> str:
    """Mean token probability to four decimals; 0.5 for no tokens."""
    mean = f"aggregate({probs}, 0D, (acc, p) -> acc + p) / size({probs})"
    return f"if(size({probs}) > 0, {sql_let('mean', mean, round_exact_sql('mean', 4))}, 0.5D)"


def span_confidence(probs: str) -> Column:
    return F.expr(span_confidence_sql(probs))


def bio_decode(text: str, scores: str) -> Column:
    """Findings of the token classifier. A span opens at B-, runs over every
    following I- whatever its type, and ends at B-, O or a special token.
    """
    spans = _runs(
        "size(ts)",
        "startswith(ts[i].label, 'B-')",
        "not startswith(ts[i].label, 'I-')",
    )
    probs = "transform(slice(ts, r.lo + 1, r.hi - r.lo), t -> t.prob)"
    found = (
        "named_struct('entity_type', kind,"
        f" 'category', try_element_at({map_sql(CATEGORY_OF)}, kind),"
        " 'start', ts[r.lo].start, 'end', ts[r.hi - 1].end,"
        f" 'matched_text', substring({text}, ts[r.lo].start + 1,"
        " ts[r.hi - 1].end - ts[r.lo].start),"
        f" 'confidence', {sql_let('probs', probs, span_confidence_sql('probs'))},"
        " 'detector', 'semantic')"
    )
    kind = semantic_type_sql("substring(ts[r.lo].label, 3)")
    return F.expr(
        sql_let(
            "ts",
            token_predictions_sql(scores),
            f"transform({spans}, r -> {sql_let('kind', kind, found)})",
        )
    )


def bio_tokens_sql(text: str) -> str:
    return f"filter(split({text}, {_SPACES}), t -> t <> '')"


def bio_tokens(text: str) -> Column:
    return F.expr(bio_tokens_sql(text))


#: Characters of text whose tags are built at a time.
_CHARACTERS = 1 << 19


def _tags(text: str | None, entities: list[dict] | None) -> list[str | None] | None:
    """Tags of the tokens of one text; of several spans over a token the last one counts."""
    if text is None:
        return None
    tokens = text.split()
    tags: list[str | None] = ["O"] * len(tokens)
    spans = []
    for i, e in enumerate(entities or ()):
        if e is not None and (e["start"] is not None or e["end"] is not None):
            low = -1 if e["start"] is None else e["start"]
            high = low + 1 if e["end"] is None else e["end"] if e["start"] is None else max(e["end"], low + 1)
            spans.append((low, i, high, e["label"]))
    if not spans:
        return tags
    spans.sort(key=lambda s: s[:2])
    places, pos, size = [], 0, len(text)
    limit = min(size, max(s[2] for s in spans))
    for token in tokens:
        while pos < size and text[pos] == " ":
            pos += 1
        if pos >= limit:  # this token and those after it are in no span
            break
        places.append(pos)
        pos += len(token)
    for low, _, high, label in spans:
        for t in range(bisect_left(places, low), bisect_left(places, high)):
            tags[t] = None if label is None else ("B-" if places[t] == low else "I-") + label
    return tags


def _tag_batches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.string())
    for texts, entities in batches:
        start = size = 0
        lengths = pc.utf8_length(texts).to_pylist()
        for i, n in enumerate(lengths, 1):
            size += n or 0
            if size >= _CHARACTERS or i == len(lengths):
                given = zip(texts[start:i].to_pylist(), entities[start:i].to_pylist())
                yield pa.array([_tags(t, e) for t, e in given], kind)
                start, size = i, 0
        if not lengths:
            yield pa.array([], kind)


def text_to_bio(text: str, entities: str) -> Column:
    """One BIO tag per whitespace token: the tag of the character reached by
    walking token lengths and skipping blanks only, so other white space shifts
    the tags after it.

    The walk is one pass over a text in Python: in SQL it takes an array with an entry per
    character, and arrays that are copied as they grow.
    """
    # Not deterministic, as far as Spark knows: so that it is never evaluated twice.
    walk = F.arrow_udf(_tag_batches, T.ArrayType(T.StringType())).asNondeterministic()
    return walk(F.expr(text), F.expr(entities))


def encode_labels(tags: str) -> Column:
    return F.expr(
        f"transform({tags}, t -> greatest(0, cast(array_position({_LABELS}, t) as int) - 1))"
    )


def align_subwords(labels: str, word_ids: str, pad_to: int = MAX_TOKENS) -> Column:
    """Word labels on sub-word pieces: special pieces are ignored, the first
    piece keeps its label, later pieces turn B- into I-.
    """
    label = f"coalesce(get({labels}, w), 0)"
    aligned = (
        f"transform({word_ids}, (w, i) -> case when w is null then {IGNORE_LABEL}"
        f" when i > 0 and get({word_ids}, i - 1) = w and {label} in (1, 3) then {label} + 1"
        f" else {label} end)"
    )
    pad = f"array_repeat({IGNORE_LABEL}, greatest(0, {pad_to} - size({word_ids})))"
    return F.expr(f"concat({aligned}, {pad})")


def entity_chunks_sql(tags: str) -> str:
    """(label, lo, hi) of each entity; an I- after O or after another type opens
    one as well.
    """
    opens = (
        f"({tags}[i] <> 'O' and (startswith({tags}[i], 'B-') or"
        f" coalesce(substring(get({tags}, i - 1), 3) <> substring({tags}[i], 3), true)))"
    )
    ranges = _runs(f"size({tags})", opens, f"({tags}[i] = 'O' or {opens})")
    return f"transform({ranges}, r -> struct(substring({tags}[r.lo], 3) as label, r.lo as lo, r.hi as hi))"


def entity_chunks(tags: str) -> Column:
    return F.expr(entity_chunks_sql(tags))
