"""Chat examples from event logs, with DataFrame functions only.

A conversation is stored as what happened to it: a message opens, streamed deltas
add to it, an edit or a regeneration starts its text anew. The log is partitioned
by conversation and message, sorted by sequence and folded into final messages;
these are rendered with a template and joined, first within blocks of neighbouring
positions and then by conversation, so a conversation with very many messages is
put together piece by piece.

Log columns: conv (any type), message (unique in its conversation), position
(long: where the message stands), seq (any type with an order, unique in the
message), kind (open, delta, edit, regenerate), role and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of event that start a message's text anew.
RESETS = ("open", "edit", "regenerate")
#: Role, mark before and mark after its text. Roles without marks of their own come last.
MARKS = (
    ("system", "<<SYS>> ", " <</SYS>>"),
    ("user", "[INST] ", " [/INST]"),
    ("assistant", "<s> ", " </s>"),
)
ROLE_OPEN, ROLE_CLOSE, OTHER_CLOSE = "[ROLE]", "[/ROLE] ", " [END]"
#: The first character of every control string; behind it an escape breaks the string.
CONTROL = r"<(?=</?SYS>>)|<(?=/?s>)|\[(?=/?INST\])|\[(?=/?ROLE\])|\[(?=END\])"
PIECES = (
    r"(?s)<<SYS>> .*? <</SYS>>|\[INST\] .*? \[/INST\]|<s> .*? </s>|\[ROLE\].*?\[/ROLE\] .*? \[END\]"
)
#: Positions in a block, and code points in a streamed delta.
BLOCK, DELTA = 256, 256
LOSS = "assistant"


def escape(text: Column) -> Column:
    """Break control strings by a backslash; backslashes are doubled."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def by_role(role: Column, pick, other: Column) -> Column:
    out = other
    for name, before, after in MARKS:
        out = F.when(role == name, pick(before, after)).otherwise(out)
    return out


def opening(role: Column) -> Column:
    other = F.concat(F.lit(ROLE_OPEN), escape(role), F.lit(ROLE_CLOSE))
    return by_role(role, lambda before, _: F.lit(before), other)


def closing(role: Column) -> Column:
    return by_role(role, lambda _, after: F.lit(after), F.lit(OTHER_CLOSE))


def fold_events(log: DataFrame) -> DataFrame:
    """The final messages: conv, message, position, role, text.

    A message's text is that of its last reset and of the deltas after it; deltas
    before any reset count if there is none. Its role is the last one given, null
    counts as empty; so does a null text. Null conversations, messages and positions
    are values like others, the latter before all numbers. Two equal rows of a log
    are two events. A message without a position takes that of its other events.
    """
    events = log.select(
        "conv", "message", "position",
        F.struct(
            "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text")
        ).alias("event"),
    )
    folded = events.groupBy("conv", "message").agg(
        F.min("position").alias("position"), F.sort_array(F.collect_list("event")).alias("events")
    )
    resets = F.filter("events", lambda e: e["kind"].isin(*RESETS))
    last = F.array_max(F.transform(resets, lambda e: e["seq"]))
    roles = F.filter("events", lambda e: e["role"].isNotNull())
    kept = F.filter("events", lambda e: F.col("last").isNull() | (e["seq"] >= F.col("last")))
    return folded.withColumn("last", last).select(
        "conv", "message", "position",
        F.coalesce(F.try_element_at(F.transform(roles, lambda e: e["role"]), F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv, formatted, loss_spans.

    Messages stand by position, then by role, text and message. A loss span is the
    number of a turn and the first and last-but-one code point of the assistant's
    text inside that turn's marked text.
    """
    marked = messages.select(
        "conv",
        F.expr(f"position div {BLOCK}").alias("block"),
        F.struct(
            "position", "role", "text", "message",
            F.concat(opening(F.col("role")), escape(F.col("text")), closing(F.col("role"))).alias("marked"),
            F.length(opening(F.col("role"))).alias("before"),
            F.length(closing(F.col("role"))).alias("after"),
        ).alias("turn"),
    )
    turns = marked.groupBy("conv", "block").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def span(t: Column, i: Column) -> Column:
        return F.struct(
            i.alias("turn"), t["before"].alias("start"), (F.length(t["marked"]) - t["after"]).alias("end"),
            (t["role"] == LOSS).alias("loss"),
        )

    blocks = turns.select(
        "conv",
        F.struct(
            "block",
            F.size("turns").alias("n"),
            F.array_join(F.transform("turns", lambda t: t["marked"]), "").alias("text"),
            F.filter(F.transform("turns", span), lambda s: s["loss"]).alias("spans"),
        ).alias("part"),
    )
    whole = blocks.groupBy("conv").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    counts = F.transform("parts", lambda p: p["n"])

    def shifted(part: Column, i: Column) -> Column:
        before = F.aggregate(F.slice("counts", F.lit(1), i), F.lit(0), lambda a, n: a + n)
        return F.transform(
            F.arrays_zip(part["spans"], F.array_repeat(before, F.size(part["spans"]))),
            lambda z: F.struct(
                (z["spans"]["turn"] + z["1"]).alias("turn"), z["spans"]["start"].alias("start"), z["spans"]["end"].alias("end")
            ),
        )

    return whole.withColumn("counts", counts).select(
        "conv",
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"),
        F.flatten(F.transform("parts", shifted)).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations: conv, turns (role and text) and loss (texts under the mask)."""

    def turn(piece: Column) -> Column:
        role = F.when(
            piece.startswith(ROLE_OPEN), unescape(F.regexp_extract(piece, r"(?s)^\[ROLE\](.*?)\[/ROLE\] ", 1))
        )
        for name, before, _ in MARKS:
            role = F.when(piece.startswith(before), name).otherwise(role)
        return F.struct(role.alias("role"), piece.alias("piece"))

    def text(t: Column) -> Column:
        start, end = F.length(opening(t["role"])), F.length(t["piece"]) - F.length(closing(t["role"]))
        return F.struct(
            t["role"].alias("role"), unescape(F.substr(t["piece"], start + 1, end - start)).alias("text")
        )

    def under(s: Column) -> Column:
        piece = F.element_at("pieces", s["turn"] + 1)
        return unescape(F.substr(piece, s["start"] + 1, s["end"] - s["start"]))

    pieces = formatted.withColumn("pieces", F.regexp_extract_all("formatted", F.lit(PIECES), F.lit(0)))
    return pieces.select(
        "conv",
        F.transform(F.transform("pieces", turn), text).alias("turns"),
        F.transform("loss_spans", under).alias("loss"),
        F.length("formatted").alias("formatted_chars"),
    )


def log_of_rows(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", delta: int = DELTA
) -> DataFrame:
    """An event log of finished messages: assistant texts as they stream, others at once."""
    base = rows.select(
        F.col(conv).alias("conv"),
        F.monotonically_increasing_id().alias("message"),
        F.col(turn).cast("long").alias("position"),
        F.col(role).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    streamed = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta}}}"), F.lit(0))
    texts = F.when(F.col("role") == LOSS, F.concat(F.array(F.lit("")), streamed)).otherwise(F.array("text"))
    parts = base.select("conv", "message", "position", "role", F.posexplode(texts).alias("seq", "text"))
    first = F.col("seq") == 0
    return parts.select(
        "conv", "message", "position", "seq",
        F.when(first, "open").otherwise("delta").alias("kind"),
        F.when(first, F.col("role")).alias("role"),
        "text",
    )


def chat_digest(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the read-back turns and the loss mask hold, as counts and digests."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss", "")
    return read_back(formatted).select(
        F.col("conv").alias(id_col),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
