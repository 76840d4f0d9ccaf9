"""Column helpers for text: regex spans with offsets, Luhn, exact rounding.

The helpers of the scan path take SQL expression text (usually a column name)
and build one SQL expression: a nested lambda costs one parse this way instead
of hundreds of calls from Python.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanguard.schema import CATEGORY_OF, FINDINGS, PATTERNS

MARK = "\\u0001"  # as written inside a SQL string

# Python's `re` is Unicode-aware. Java's (?U) agrees with it except on the
# characters of _ODD (marks, joiners, number forms, separators); texts that hold
# one of those get \\w, \\d and \\s spelled out, which is several times slower.
_WORD = r"[\p{L}\p{N}_]"
_SPACE = r"\s\x1c-\x1f\x85\p{Z}"
_BOUNDARY = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_ODD = (
    r"(?![\x00-\x1b\x20-\x7f])"
    r"[\x1c-\x1f[\p{IsAlphabetic}\p{M}\p{N}\p{Pc}\p{IsJoin_Control}&&[^\p{L}\p{Nd}_]]]"
)

# What a text must hold for a pattern to match, and the first characters a
# match can have. Both only save work.
_FOUR_DIGITS = r"{t} rlike r'\p{{Nd}}{{4}}'"  # bound to `numeric` once per text
_GUARDS = {
    "EMAIL": "contains({t}, '@')",
    "PHONE": "numeric",
    "SSN": "numeric and contains({t}, '-')",
    "CREDIT_CARD": "numeric",
    "AWS_KEY": "contains({t}, 'AKIA')",
    "GITHUB_TOKEN": "contains({t}, 'ghp_') or contains({t}, 'github_pat_')",
    "JWT": "contains({t}, 'eyJ')",
}
_FIRST = {
    "PHONE": r"(?=[+(\p{Nd}])",
    "SSN": r"(?=\p{Nd})",
    "CREDIT_CARD": r"(?=\p{Nd})",
    "AWS_KEY": "(?=A)",
    "GITHUB_TOKEN": "(?=g)",
    "JWT": "(?=e)",
}

EMPTY_FINDINGS = f"cast(array() as {FINDINGS.simpleString()})"


def java_regex(pattern: str, exact: bool = True) -> str:
    """Java form of a Python pattern that uses \\b, \\d and (in classes) \\s."""
    # A run that cannot hold the @ after it never needs to be given back.
    pattern = pattern.replace("]+@", "]++@").replace(r"\d", r"\p{Nd}")
    if not exact:
        return "(?U)" + pattern
    return pattern.replace(r"\b", _BOUNDARY).replace(r"\s", _SPACE)


def sql_let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def empty(array_type) -> Column:
    return F.array().cast(array_type)


def finding(entity_type, start, end, matched, confidence, detector, category):
    """One finding struct in the field order of `schema.FINDING`."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(entity_type).alias("entity_type"),
        category.alias("category"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        matched.alias("matched_text"),
        as_col(confidence).cast("double").alias("confidence"),
        as_col(detector).alias("detector"),
    )


def _running_sql(values: str, step: str, block: int) -> str:
    """Running results of `step` (over {a} and {b}, with 0 as its neutral element).

    Appending to an array copies it, so long arrays are taken in blocks: each block on
    its own, then combined with the result of the blocks before it.
    """

    def runs(xs: str) -> str:
        return (
            f"aggregate({xs}, cast(array() as array<int>), (acc, x) ->"
            f" array_append(acc, {step.format(a='coalesce(try_element_at(acc, -1), 0)', b='x')}))"
        )

    blocked = sql_let(
        "bs",
        f"transform(sequence(1, size(vs), {block}), c -> {runs(f'slice(vs, c, {block})')})",
        sql_let(
            "ts",
            runs("transform(bs, b -> element_at(b, -1))"),
            "flatten(transform(bs, (b, j) ->"
            f" transform(b, x -> {step.format(a='x', b='coalesce(get(ts, j - 1), 0)')})))",
        ),
    )
    return sql_let("vs", values, f"if(size(vs) > {block}, {blocked}, {runs('vs')})")


def running_sum_sql(values: str, block: int = 32) -> str:
    """Inclusive running sums of an int array."""
    return _running_sql(values, "{a} + {b}", block)


def running_max_sql(values: str, block: int = 32) -> str:
    """Inclusive running maxima of an array of non-negative ints."""
    return _running_sql(values, "greatest({a}, {b})", block)


def ranks_below_sql(places: str, limits: str) -> str:
    """For each of the int array `limits` how many of the int array `places` are below it.

    Both are sorted together once, so no limit is compared with all places.
    """
    marks = (
        f"array_sort(concat(transform({limits}, (q, i) -> struct(q as v, 0 as place, i as i)),"
        f" transform({places}, q -> struct(q as v, 1 as place, 0 as i))))"
    )
    found = (
        "transform(array_sort(filter(transform(ms, (m, j) -> struct(m.place as place, m.i as i, ns[j] as n)),"
        " m -> m.place = 0)), m -> m.n)"
    )
    return sql_let("ms", marks, sql_let("ns", running_sum_sql("transform(ms, m -> m.place)"), found))


def _marked(text: str, entity_type: str) -> str:
    """Struct of one pattern and the text with every match between markers, or
    null where a guard rules a match out.
    """
    pattern, confidence = next((p, c) for e, p, c in PATTERNS if e == entity_type)
    first = _FIRST.get(entity_type, "")
    safe = f"if(contains({text}, '{MARK}'), translate({text}, '{MARK}', ' '), {text})"
    exact, fast = (
        f"regexp_replace({safe}, r'{first}{java_regex(pattern, e)}', '{MARK}$0{MARK}')"
        for e in (True, False)
    )
    marked = f"if(odd, {exact}, {fast})"
    guard = _GUARDS[entity_type].format(t=text)
    return (
        f"named_struct('type', '{entity_type}', 'category', '{CATEGORY_OF[entity_type]}',"
        f" 'confidence', {confidence}D, 'marked', if({guard}, {marked}, null))"
    )


def _locate() -> str:
    """Findings of a marked text `m`: split at the markers, odd pieces are
    matches and the running length of the pieces gives their offsets.
    """
    found = (
        "transform(sequence(1, size(ps) - 1, 2), i -> named_struct("
        "'entity_type', m.type, 'category', m.category,"
        " 'start', es[i - 1], 'end', es[i], 'matched_text', ps[i],"
        " 'confidence', m.confidence, 'detector', 'regex'))"
    )
    ends = running_sum_sql("transform(ps, p -> length(p))")
    return sql_let(
        "ps",
        f"split(m.marked, '{MARK}', -1)",
        f"if(size(ps) > 1, {sql_let('es', ends, found)}, {EMPTY_FINDINGS})",
    )


def findings_sql(text: str, entity_types: list[str] | None = None) -> str:
    """All non-overlapping matches per pattern with code-point offsets, in
    pattern order. Patterns may overlap one another.
    """
    wanted = [e for e, _, _ in PATTERNS if entity_types is None or e in entity_types]
    marked = f"array({', '.join(_marked(text, e) for e in wanted)})"
    marked = sql_let("odd", f"{text} rlike r'{_ODD}'", marked)
    marked = sql_let("numeric", _FOUR_DIGITS.format(t=text), marked)
    found = (
        f"flatten(transform(filter({marked}, m -> m.marked is not null), m -> {_locate()}))"
    )
    if "CREDIT_CARD" in wanted:
        luhn = luhn_sql("f.matched_text")
        found = f"filter({found}, f -> f.entity_type <> 'CREDIT_CARD' or {luhn})"
    return found


def pattern_findings(
    text: str, pattern: str, entity_type: str, category: str, confidence: float, detector: str
) -> Column:
    """All non-overlapping matches of a Java pattern as findings of a detector of one's own.

    `pattern` must not match the empty text and may hold no quotes.
    """
    safe = f"translate({text}, '{MARK}', ' ')"
    found = (
        "transform(if(size(ps) > 1, sequence(1, size(ps) - 1, 2), cast(array() as array<int>)), i -> named_struct("
        f"'entity_type', '{entity_type}', 'category', '{category}', 'start', es[i - 1], 'end', es[i],"
        f" 'matched_text', ps[i], 'confidence', {confidence}D, 'detector', '{detector}'))"
    )
    split = f"split(regexp_replace({safe}, r'{pattern}', '{MARK}$0{MARK}'), '{MARK}', -1)"
    return F.expr(sql_let("ps", split, sql_let("es", running_sum_sql("transform(ps, p -> length(p))"), found)))


def regex_findings(text: str, entity_types: list[str] | None = None) -> Column:
    return F.expr(findings_sql(text, entity_types))


@lru_cache
def _digit_zeros() -> list[int]:
    """Code points of every script's zero; the nine that follow are its digits."""
    chars = map(chr, range(sys.maxunicode + 1))
    return [
        ord(c)
        for c in chars
        if unicodedata.category(c) == "Nd" and unicodedata.digit(c) == 0
    ]


def luhn_sql(number: str) -> str:
    """Exactly 16 digits (separators ignored) that pass the mod-10 check."""
    zeros = ", ".join(map(str, _digit_zeros()))
    other = f"code - array_max(filter(array({zeros}), z -> z <= code))"
    value = sql_let(
        "code",
        "ascii(substr(ds, n, 1))",
        f"if(code between 48 and 57, code - 48, {other})",
    )
    weigh = sql_let(
        "d", f"({value}) * (2 - n % 2)", "if(d > 9, d - 9, d)"
    )
    total = f"aggregate(sequence(1, 16), 0, (acc, n) -> acc + {weigh})"
    digits = f"reverse(regexp_replace({number}, r'\\P{{Nd}}', ''))"
    return sql_let("ds", digits, f"if(length(ds) = 16, {total} % 10 = 0, false)")


def luhn_valid(number: str) -> Column:
    return F.expr(luhn_sql(number))


def exact_round_sql(x: str, digits: int) -> str:
    """`x` in [0, 1] scaled by 10^digits and rounded half-even on its exact
    binary value, as an int (0.945 -> 94: it is stored below .945).
    """
    one = f"cast({2**62} as decimal(20,0))"
    scaled = (
        f"cast(cast({x} * {float(2**62)!r}D as bigint) as decimal(20,0))"
        f" * cast({10**digits} as decimal(10,0))"
    )
    low = f"cast((sc - sc % {one}) / {one} as int)"
    twice = f"(sc % {one}) * 2"
    return sql_let(
        "sc",
        scaled,
        f"{low} + if({twice} > {one} or ({twice} = {one} and {low} % 2 = 1), 1, 0)",
    )


def round_exact_sql(x: str, digits: int) -> str:
    return f"({exact_round_sql(x, digits)} / {float(10**digits)!r}D)"


def round_exact(x: str, digits: int) -> Column:
    return F.expr(round_exact_sql(x, digits))


def fixed2_sql(x: str) -> str:
    """Two-decimal text of a confidence, as C's %.2f prints it."""
    return sql_let(
        "h",
        exact_round_sql(x, 2),
        "concat(cast(h div 100 as string), '.', lpad(cast(h % 100 as string), 2, '0'))",
    )


def fixed2(x: str) -> Column:
    return F.expr(fixed2_sql(x))
