"""Helpers over arrays of findings: merge, categories, redaction. Arguments
called `text` and `spans` are SQL expression text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanguard.functions.text import running_max_sql, running_sum_sql, sql_let
from spanguard.schema import (
    CATEGORY_OF,
    CONCLUSIVE_CONFIDENCE,
    CONCLUSIVE_DETECTOR,
    COUNTS,
    DETECTOR_PRIORITY,
    TOKEN_OF,
)

_BLOCK = 64
EMPTY_COUNTS = f"cast(map() as {COUNTS.simpleString()})"


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def map_sql(pairs: dict) -> str:
    return "map(" + ", ".join(f"{k!r}, {v!r}" for k, v in pairs.items()) + ")"


def category_of(entity_type: Column) -> Column:
    return F.try_element_at(literal_map(CATEGORY_OF), entity_type)


def token_sql(entity_type: str) -> str:
    return f"coalesce(try_element_at({map_sql(TOKEN_OF)}, {entity_type}), '[REDACTED]')"


def merge_overlaps(spans: str, extra_priorities: dict | None = None) -> Column:
    """Greedy walk over findings sorted by (start, confidence desc, priority
    desc): an overlapping span replaces the last kept one only if it is surer,
    or equally sure and from a detector of higher priority.
    """
    known = map_sql({**DETECTOR_PRIORITY, **(extra_priorities or {})})
    keyed = (
        f"array_sort(transform({spans}, (f, i) -> struct(f.start as start,"
        " -f.confidence as neg_conf,"
        f" -coalesce(try_element_at({known}, f.detector), 0) as neg_prio,"
        " i as ord, f as f)))"
    )
    # Without an overlap between neighbours the walk keeps every span.
    clash = "exists(sequence(1, size(ks) - 1), i -> ks[i].start < ks[i - 1].f.end)"
    apart = "k.start >= acc.last.f.end"
    better = (
        "k.neg_conf < acc.last.neg_conf or"
        " (k.neg_conf = acc.last.neg_conf and k.neg_prio < acc.last.neg_prio)"
    )
    # Appending copies the array, so kept spans are collected per block.
    in_block = (
        f"aggregate(slice(cl, c, {_BLOCK}), struct(slice(cl, 1, 0) as done, whole.last as last),"
        f" (acc, k) -> struct(if({apart}, array_append(acc.done, acc.last), acc.done) as done,"
        f" if({apart} or {better}, k, acc.last) as last))"
    )
    step = sql_let("b", in_block, "struct(array_append(whole.blocks, b.done) as blocks, b.last as last)")
    walked = (
        f"aggregate(sequence(2, size(cl), {_BLOCK}), struct(array(slice(cl, 1, 0)) as blocks, cl[0] as last),"
        f" (whole, c) -> {step}, whole -> array_append(flatten(whole.blocks), whole.last))"
    )
    # Where a span starts behind the ends of all before it, the walk starts anew: only
    # the clusters between such places are walked.
    cuts = "filter(sequence(0, size(ks) - 1), i -> i = 0 or ks[i].start >= mx[i - 1])"
    clusters = (
        "flatten(transform(cs, (c, j) -> "
        + sql_let(
            "cl",
            "slice(ks, c + 1, coalesce(get(cs, j + 1), size(ks)) - c)",
            f"if(size(cl) > 1, {walked}, cl)",
        )
        + "))"
    )
    split = sql_let("mx", running_max_sql("transform(ks, k -> k.f.end)"), sql_let("cs", cuts, clusters))
    kept = sql_let("ks", keyed, f"transform(if({clash}, {split}, ks), k -> k.f)")
    return F.expr(f"if(size({spans}) > 1, {kept}, {spans})")


def redact(text: str, spans: str) -> Column:
    """Replace each span by the token of its type.

    `spans` must be sorted by start and free of overlaps, as `merge_overlaps`
    returns them; a filtered subset of those is fine too.
    """
    gap_from = f"if(i > 0, get({spans}, i - 1).end, 0)"
    piece = (
        f"concat(substring({text}, {gap_from} + 1, s.start - {gap_from}),"
        f" {token_sql('s.entity_type')})"
    )
    tail = f"substring({text}, element_at({spans}, -1).end + 1)"
    return F.expr(
        f"if(size({spans}) > 0, concat(array_join(transform({spans},"
        f" (s, i) -> {piece}), ''), {tail}), {text})"
    )


def redaction_counts(spans: str) -> Column:
    """Entity type -> number of spans; an empty map when there are none."""
    types = f"array_sort(array_distinct(transform({spans}, s -> s.entity_type)))"
    count = f"cast(size(filter({spans}, s -> s.entity_type = t)) as bigint)"
    counted = sql_let("ts", types, f"map_from_arrays(ts, transform(ts, t -> {count}))")
    return F.expr(f"if(size({spans}) > 0, {counted}, {EMPTY_COUNTS})")


def needs_semantic(spans: str) -> Column:
    """Whether no pattern match is sure enough to skip the token classifier."""
    return F.expr(
        f"not exists({spans}, f -> f.detector = '{CONCLUSIVE_DETECTOR}'"
        f" and f.confidence >= {CONCLUSIVE_CONFIDENCE}D)"
    )


def redaction_pieces(text: str) -> Column:
    """Redacted text in reading order, as (text, category): a redaction token has the category
    its text implies, a plain piece between tokens null. Joined they are the text again;
    an empty text has no pieces.
    """
    # Tokens are put between markers; no text but a marker's own holds both in this order.
    mark = r"regexp_replace(translate({t}, '\u0001\u0002', '\u0002\u0002'), r'(\[REDACTED_\w*\])', concat('\u0001', '$1', '\u0001'))"
    split = sql_let(
        "ps",
        f"split({mark.format(t=text)}, '\u0001', -1)",
        sql_let("es", running_sum_sql("transform(ps, p -> length(p))"), "transform(ps, (p, i) -> struct("
            f"substring({text}, es[i] - length(p) + 1, length(p)) as text,"
            " case when i % 2 = 0 then null when p = '[REDACTED_SECRET]' then 'SECRET' else 'PII' end as category))"),
    )
    return F.expr(f"filter({split}, p -> p.text <> '')")


def redaction_marks(text: str) -> Column:
    """Redaction tokens in reading order with the category their text implies."""
    marks = F.filter(redaction_pieces(text), lambda p: p["category"].isNotNull())
    return F.transform(marks, lambda p: F.struct(p["text"].alias("token"), p["category"].alias("category")))
