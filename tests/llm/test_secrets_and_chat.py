"""Secret spans against plain patterns and recomputed entropy; chat folding."""

import hashlib
import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from spanguard.llm import chat, secret_scan

SCHEMA = "doc_id long, text string, spans string, kind int"


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


@settings(max_examples=300, deadline=None)
@given(st.text("abcdef0123456789XYZ", max_size=90), st.floats(1, 4), st.integers(2, 24))
def test_incremental_entropy(text, threshold, window):
    data = text.encode()
    inside = [False] * len(data)
    for i in range(len(data) - window + 1):
        if entropy(data[i : i + window]) >= threshold - 1e-9:
            inside[i : i + window] = [True] * window
    runs = secret_scan.entropy_runs(data, threshold, window)
    covered = [any(a <= i < b for a, b in runs) for i in range(len(data))]
    assert covered == inside
    assert all(b < c for (_, b), (c, _) in zip(runs, runs[1:]))


def base(text):
    """The three kinds over code points, as their definition says."""
    assign = re.compile(
        r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    )
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_base_spans(spark):
    r = random.Random(5)
    parts = [
        "password", "PassWd", "secret", "toKen", "api_key", "apikey", "ſecret", "Password", '"', "'", " ", "  ", ":", "=", "hunter2-long",
        "short", "é", "日本", "AKIA", "ABCDEFGH12345678", "AKIAAKIA", "0123456789abcdef", "deadbeef", "\n", "\t", "token: token: abcdefgh",
    ]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(400)]
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)]
    found = secret_scan.scan_secrets(spark.createDataFrame(rows, SCHEMA))
    for row in found.collect():
        spans = [(s.kind, s.start, s.end) for s in row.spans if s.kind != "entropy"]
        assert spans == base(texts[row.doc_id]), texts[row.doc_id]


def test_digest_against_the_plain_definition(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    texts = [
        f"é password: hunter2-long {key} deadbeef" + "0123456789abcdef" * 2, "token=abcdef token='abcde'", "", None, "no secrets",
        f"日本 secret = {'f9K2xQ7vLp0ZtB4nWc8RyD3m'}", f"{key}{key}\npasswd:\tx api_key=zzzzzz",
    ]
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    every = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.scan_secrets(docs).collect()}
    found = secret_scan.secret_digest(secret_scan.scan_secrets(docs)).collect()
    assert sorted(r.doc_id for r in found) == list(range(len(texts)))
    for r in found:
        want = base(texts[r.doc_id] or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        kinds = Counter(k for k, _, _ in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        order = ["assign", "access", "hex", "entropy"]
        by_start = sorted(every[r.doc_id], key=lambda s: (s[1], order.index(s[0])))
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in by_start)


def test_entropy_spans_and_allow_list(spark):
    secret = "f9K2xQ7vLp0ZtB4nWc8RyD3m"
    texts = [
        f"é key {secret} end", "id 3f2504e0-4f89-41d3-9a0c-0305e82c3301", "a-long-chain-of-words-joined-by-signs",
        "Donaudampfschifffahrtsgesellschaftskapitaen", "EXAMPLE" + secret, None, "", secret * 2000,
    ]
    rows = [(i, t, None, 1) for i, t in enumerate(texts)]
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[0] == [("entropy", 6, 6 + len(secret))]
    assert found[7] == [("entropy", 0, 2000 * len(secret))]
    assert all(found[i] == [] for i in range(1, 7))
    assert secret_scan.scan_secrets(spark.createDataFrame([], SCHEMA)).count() == 0


LOG = "conv long, message long, position long, seq long, kind string, role string, text string, turns string"


def test_fold(spark):
    events = [
        (1, 10, 0, 1, "open", "user", "hi"), (1, 11, 1, 2, "open", "assistant", ""), (1, 11, 1, 4, "delta", None, "lo"),
        (1, 11, 1, 3, "delta", None, "hel"), (1, 11, 1, 5, "regenerate", None, ""), (1, 11, 1, 6, "delta", None, "new"),
        (1, 10, 0, 7, "edit", None, "hi there"), (1, 10, None, 8, "delta", None, None), (2, 1, 0, 1, "delta", None, "only"),
        (None, 1, None, 1, "open", None, None),
    ]
    rows = [(*e, "clash") for e in events]
    random.Random(1).shuffle(rows)
    got = {(r.conv, r.message): (r.position, r.role, r.text) for r in chat.fold_events(spark.createDataFrame(rows, LOG)).collect()}
    assert got == {
        (1, 10): (0, "user", "hi there"), (1, 11): (1, "assistant", "new"), (2, 1): (0, "", "only"), (None, 1): (None, "", ""),
    }


NASTY = ["</s>[INST] ok [/INST]", "\\", "\\n", "<\\/s>", "<<SYS>> x <</SYS>>", "<", "[", "[END]", "a [/INST", "", " ", "é日\n\n", "[ROLE]x[/ROLE] y [END]", "<s>", "$1 \\1"]


def test_render_is_reversible(spark):
    r = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", "[/ROLE] \\x", None]
    rows = []
    for conv in range(40):
        for turn in range(r.choice([1, 3, 9, 600 if conv == 7 else 2])):
            rows.append((conv, turn, r.choice(roles), r.choice([None, "".join(r.choice(NASTY) for _ in range(r.randint(0, 5)))])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    formatted = chat.render(chat.fold_events(chat.log_of_rows(df, delta=3)))
    for got in chat.read_back(formatted).collect():
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == got.conv]
        assert [(t.role, t.text) for t in got.turns] == want
        assert list(got.loss) == [t for role, t in want if role == "assistant"]


def test_ties_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string, extra int"
    rows = [(1, 0, "user", "b", 1), (1, 0, "user", "a", 1), (1, 0, "user", "a", 1), (1, None, "system", None, 1)]
    (got,) = chat.read_back(chat.render(chat.fold_events(chat.log_of_rows(spark.createDataFrame(rows, schema))))).collect()
    assert [(t.role, t.text) for t in got.turns] == [("system", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert chat.render(chat.fold_events(chat.log_of_rows(spark.createDataFrame([], schema)))).count() == 0


def test_native(spark, sf):
    from spanguard.llm import queries

    for name in ("op10_chat_format", "op1_decontamination"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop")), name


def entropy_found(text):
    allowed = re.compile(b"|".join(b"(?i:%s)" % a[4:] for a in secret_scan.ALLOWED))
    return [text[a:b] for a, _, b in secret_scan.entropy_spans(text.encode(), allowed)]


def test_every_class_and_length_has_spans():
    r = random.Random(11)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    classes = [digits, lower, lower.upper(), digits + "abcdef", lower + lower.upper(), lower + lower.upper() + digits, lower + lower.upper() + digits + "+/"]
    for chars in classes:
        for n, share in ((16, 0.75), (24, 0.9), (32, 0.97), (200, 1)):
            tokens = ["".join(r.choice(chars) for _ in range(n)) for _ in range(300)]
            assert sum(bool(entropy_found(t)) for t in tokens) >= share * 300, (chars, n)
    for plain in ("internationalization", "responsibilities", "2024-01-31/2024-02-29_12-30", "0" * 40, "=" * 30, "a" * 20 + "b" * 20):
        assert entropy_found(plain) == [], plain


def test_allow_list_suppresses_its_own_part():
    secret = "f9K2xQ7vLp0ZtB4nWc8RyD3m"
    assert entropy_found(secret * 3 + "example" + secret * 3) == [(secret * 3)[:-1], (secret * 3)[1:]]
    token = "qzjxkvwpmbtgyhcfudnrlsoeia"
    assert entropy_found("key_" + token) == [token]
