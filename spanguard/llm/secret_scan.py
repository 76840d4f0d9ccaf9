"""Secrets in texts: three fixed patterns, and windows of high entropy.

The entropy scan looks at candidate strings (long unbroken runs of token
characters). A candidate's character class is the narrowest that holds all its
characters; each class has a threshold of its own for each window length. A window
slides over the candidate, 24 characters long or, in shorter candidates, 16; its
Shannon entropy follows from the counts of its characters, which change by one
character in and one out, so a step costs two table lookups however long the window
is. Overlapping windows over the threshold are one span. The allow list suppresses
the windows that hold or touch what it matches; the rest of the candidate counts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanguard.llm.common import as_bytes, id_type

# The base patterns. Lengths are checked after matching, because a
# match that is too short still uses up its characters.
ASSIGN = re.compile(
    rb"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_HINTS = (b"pass", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")  # runs are maximal: the same as 20+ of AKIA[A-Z0-9]+
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

WINDOW, SHORT = 24, 16
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % SHORT)
#: Name, characters and bits per character from which a window counts (of WINDOW and of
#: SHORT characters), narrowest first. They lie between what ordinary and what random
#: strings of the class reach; README has the shares on either side.
CLASSES = (
    ("digits", re.compile(rb"[0-9]+"), 2.65, 2.4),
    ("lower", re.compile(rb"[a-z]+"), 3.56, 3.3),
    ("upper", re.compile(rb"[A-Z]+"), 3.56, 3.3),
    ("hex", re.compile(rb"[0-9a-fA-F]+"), 2.9, 2.7),
    ("letters", re.compile(rb"[A-Za-z]+"), 3.9, 3.45),
    ("alnum", re.compile(rb"[A-Za-z0-9]+"), 3.7, 3.45),
    ("base64", re.compile(rb"[A-Za-z0-9+/_=-]+"), 3.8, 3.5),
)
#: Whole candidates that look random but aren't secrets.
ALLOWED = (rb"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}",)  # UUID
#: Parts of candidates that mark what is around them as no secret.
ALLOWED_PARTS = re.compile(rb"(?i)example|sample|placeholder|abcdefgh|0123456789")
#: Numbers, dates and rules made of signs, and words joined by signs: signs and short
#: pieces are no secret, each long piece is a candidate of its own.
JOINED = re.compile(rb"[0-9+/_=-]*[+/_=-][0-9+/_=-]*|[A-Z]?[a-z]*([-_/+=][A-Z]?[a-z]*)+")
PIECE = re.compile(rb"[A-Za-z0-9]{%d,}" % SHORT)
#: c * log2(c) for the counts that a window can hold.
PLOGP = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]


def entropy_runs(s: bytes, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged spans of the windows of `s` whose entropy reaches the threshold."""
    if len(s) < window:
        return []
    plogp = PLOGP if window <= WINDOW else [0.0, *(c * math.log2(c) for c in range(1, window + 1))]
    most = window * (math.log2(window) - threshold) + 1e-9  # entropy >= threshold: sum of plogp <= most
    counts, total = [0] * 256, 0.0
    for b in s[:window]:
        total += plogp[counts[b] + 1] - plogp[counts[b]]
        counts[b] += 1
    runs: list[tuple[int, int]] = []
    for at in range(len(s) - window + 1):
        if at:
            out, new = s[at - 1], s[at + window - 1]
            total += plogp[counts[out] - 1] - plogp[counts[out]]
            counts[out] -= 1
            total += plogp[counts[new] + 1] - plogp[counts[new]]
            counts[new] += 1
        if total <= most:
            if runs and at <= runs[-1][1]:
                runs[-1] = (runs[-1][0], at + window)
            else:
                runs.append((at, at + window))
    return runs


def base_spans(data: bytes) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the three fixed patterns, in bytes."""
    found = []
    low = data.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(data) if m.end(1) - m.start(1) >= 6]
    if b"AKIA" in data:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(data)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(data)]
    return found


def candidates(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Place and characters of each string to be judged."""
    for m in CANDIDATE.finditer(data):
        if JOINED.fullmatch(m.group()):
            yield from ((m.start() + p.start(), p.group()) for p in PIECE.finditer(m.group()))
        else:
            yield m.start(), m.group()


def entropy_spans(data: bytes, allowed: re.Pattern, parts: re.Pattern = ALLOWED_PARTS) -> list[tuple[int, str, int]]:
    found = []
    for at, s in candidates(data):
        if allowed.fullmatch(s):
            continue
        long, short = next(bits for _, chars, *bits in CLASSES if chars.fullmatch(s))
        window, threshold = (WINDOW, long) if len(s) >= WINDOW else (SHORT, short)
        # Between allowed parts, without the character next to them.
        marks = [(m.start() - 1, m.end() + 1) for m in parts.finditer(s)]
        for a, b in zip([0, *(end for _, end in marks)], [*(start for start, _ in marks), len(s)]):
            if b - a >= window:
                found += [(at + a + x, "entropy", at + a + y) for x, y in entropy_runs(s[a:b], threshold, window)]
    return found


def to_code_points(data: bytes, spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Byte offsets as code point offsets, by start and then kind."""
    if spans and not data.isascii():
        places = sorted({p for a, _, b in spans for p in (a, b)})
        at, n, where = 0, 0, {}
        for p in places:
            n += len(data[at:p].decode())
            at = where[p] = p
            where[p] = n
        spans = [(where[a], k, where[b]) for a, k, b in spans]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: tuple[bytes, ...] = ALLOWED
) -> DataFrame:
    """Each row's secrets as an array of (kind, start, end), by start and then kind.

    Offsets are code points, end exclusive. A null text counts as empty and has
    none; repeated rows each give a row; null ids stay null. Texts of any length
    are scanned whole. An empty table gives an empty result.
    """
    pattern = re.compile(b"|".join(b"(?:%s)" % (a if not a.startswith(b"(?i)") else b"(?i:%s)" % a[4:]) for a in allowed) or rb"(?!)")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [
                [
                    {"kind": k, "start": a, "end": b}
                    for a, k, b in to_code_points(data, base_spans(data) + entropy_spans(data, pattern))
                ]
                for data in as_bytes(batch.column(1))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(scan, f"id {id_type(docs, id_col)}, spans array<struct<kind string, start int, end int>>")
    return out.select(F.col("id").alias(id_col), "spans")


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""

    def text(only_base: bool):
        kept = F.filter("spans", lambda s: s["kind"] != "entropy") if only_base else F.col("spans")
        return F.array_join(
            F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        id_col, count("assign"), count("access"), count("hex"),
        F.sha2(text(True), 256).alias("base_sha256"), text(False).alias("spans"),
    )
