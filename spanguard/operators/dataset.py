"""Labelled examples: synthesis, checks, BIO rows and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanguard.functions.bio import bio_tokens, encode_labels, text_to_bio
from spanguard.functions.spans import map_sql

DIGIT_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]

# Relative sizes of the seven families of positive examples: a default of our own.
FAMILIES = [
    ("email", 5),
    ("phone", 4),
    ("ssn", 3),
    ("password", 4),
    ("api_key", 3),
    ("card", 2),
    ("implied", 1),
]

# (family, label, text before the entity, text after it)
TEMPLATES = [
    ("email", "PII", "mail it to ", ""),
    ("email", "PII", "please add ", " to the list"),
    ("email", "PII", "my work contact is ", " most days"),
    ("phone", "PII", "you can ring ", ""),
    ("phone", "PII", "after hours dial ", " and ask for me"),
    ("ssn", "PII", "the social on file is ", ""),
    ("ssn", "PII", "for the form use ", " as the number"),
    ("password", "SECRET", "log in with ", ""),
    ("password", "SECRET", "the new password is ", " until friday"),
    ("api_key", "SECRET", "set the key to ", ""),
    ("api_key", "SECRET", "requests need ", " in the header"),
    ("card", "PII", "the card begins with ", ""),
    ("card", "PII", "bill the one ending in ", " this time"),
    ("implied", "SECRET", "", ""),
]
IMPLIED = [
    "the door code is my street number read backwards",
    "my login is the name of our cat and the year we moved",
    "the pin is half of my old phone number",
]
NEGATIVES = [
    "the ferry to the island leaves every forty minutes",
    "our choir rehearses in room four hundred and two",
    "stir two cups of flour into the batter and wait",
    "the museum keeps nine maps that nobody can date",
    "on monday the night train was eleven minutes late",
]
FIRST = "ada ben cleo dario elif finn greta hugo".split()
LAST = "abbott berg castro dahl evans fischer grant holm".split()
DOMAINS = "mailbox example office post".split()
TLDS = "com org net".split()
KEY_PREFIXES = ["sk-", "pk_", "tok_", "key-"]


def _array(items: Sequence[str]) -> str:
    return "array(" + ", ".join(f"'{i}'" for i in items) + ")"


def hash_pick(key: str, salt: str, n: int) -> str:
    """A number in 0..n-1 that depends on `key` and `salt` only (SQL text)."""
    return f"(cast(conv(substring(md5(concat({key}, '|{salt}')), 1, 8), 16, 10) as bigint) % {n})"


def _choice(key: str, salt: str, items: Sequence[str]) -> str:
    return f"get({_array(items)}, cast({hash_pick(key, salt, len(items))} as int))"


def digits_to_words_sql(digits: str) -> str:
    words = map_sql({str(i): w for i, w in enumerate(DIGIT_WORDS)})
    only = f"regexp_replace({digits}, '[^0-9]', '')"
    return (
        f"array_join(transform(filter(split({only}, ''), d -> d <> ''),"
        f" d -> element_at({words}, d)), ' ')"
    )


def digits_to_words(digits: str) -> Column:
    """Digits as words; everything else is dropped."""
    return F.expr(digits_to_words_sql(digits))


def _number(key: str, salt: str, low: int, high: int) -> str:
    return f"cast({low} + {hash_pick(key, salt, high - low + 1)} as string)"


def _value_sql(family: str, key: str) -> str:
    words = digits_to_words_sql
    num = lambda salt, low, high: words(_number(key, salt, low, high))
    return {
        "email": f"concat({_choice(key, 'first', FIRST)}, ' dot ', {_choice(key, 'last', LAST)},"
        f" ' at ', {_choice(key, 'domain', DOMAINS)}, ' dot ', {_choice(key, 'tld', TLDS)})",
        "phone": f"concat_ws(' ', {num('a', 200, 999)}, {num('b', 100, 999)}, {num('c', 1000, 9999)})",
        "ssn": f"concat_ws(' dash ', {num('a', 100, 999)}, {num('b', 10, 99)}, {num('c', 1000, 9999)})",
        "password": f"concat({_choice(key, 'last', LAST)}, {_number(key, 'c', 10, 9999)})",
        "api_key": f"concat({_choice(key, 'prefix', KEY_PREFIXES)},"
        f" substring(md5(concat({key}, '|key')), 1, 20))",
        "card": num("card", 1000, 9999),
        "implied": _choice(key, "implied", IMPLIED),
    }[family]


def synthesize(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One positive example per row: family, text and its exact entity span. All
    picks are hashes of the key and the seed, so any partitioning gives the
    same rows.
    """
    k, total = "_key", sum(n for _, n in FAMILIES)
    cases, bound = [], 0
    for family, n in FAMILIES:
        bound += n
        cases.append(f"when _r < {bound} then '{family}'")
    by_family = []
    for family, _ in FAMILIES:
        mine = [t for t in TEMPLATES if t[0] == family]
        structs = ", ".join(
            f"struct('{label}' as label, '{pre}' as pre, '{post}' as post)"
            for _, label, pre, post in mine
        )
        pick = hash_pick(k, "template", len(mine))
        by_family.append(
            f"when family = '{family}' then struct(get(array({structs}), cast({pick} as int))"
            f" as t, {_value_sql(family, k)} as v)"
        )
    span = F.struct(
        F.length("_x.t.pre").alias("start"),
        (F.length("_x.t.pre") + F.length("_x.v")).alias("end"),
        F.col("_x.t.label").alias("label"),
    )
    return (
        df.withColumn(k, F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
        .withColumn("_r", F.expr(hash_pick(k, "family", total)))
        .withColumn("family", F.expr(f"case {' '.join(cases)} end"))
        .withColumn("_x", F.expr(f"case {' '.join(by_family)} end"))
        .select(
            key,
            "family",
            F.concat("_x.t.pre", "_x.v", "_x.t.post").alias("text"),
            F.array(span).alias("entities"),
        )
    )


def hard_negatives(
    df: DataFrame, key: str, seed: int = 42, templates: Sequence[str] = NEGATIVES
) -> DataFrame:
    """One example without entities per row."""
    k = f"concat(cast({key} as string), '|{seed}')"
    return df.select(
        key,
        F.expr(_choice(k, "negative", templates)).alias("text"),
        F.array().cast("array<struct<start:int,end:int,label:string>>").alias("entities"),
    )


def verify_spans(text: str = "text", entities: str = "entities") -> Column:
    """Whether every span holds more than blanks."""
    return F.expr(
        f"forall({entities}, e -> trim(BOTH ' \\t\\n\\r' FROM"
        f" substring({text}, e.start + 1, e.end - e.start)) <> '')"
    )


def cap_negatives(negatives: DataFrame, n: int = 80, order: str = "line") -> DataFrame:
    """The first `n` negatives in file order, as the training mix is defined."""
    return negatives.orderBy(order).limit(n)


def merge_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Union of labelled sources with their name. A missing source is left out
    by not passing it.
    """
    parts = [df.select(F.lit(n).alias("source"), "text", "entities") for n, df in sources.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def bio_rows(examples: DataFrame, *keys: str) -> DataFrame:
    """Tokens, BIO tags and label ids of labelled examples."""
    return (
        examples.withColumn("_text", F.col("text"))
        .withColumn("tokens", bio_tokens("_text"))
        .withColumn("tags", text_to_bio("_text", "entities"))
        .withColumn("labels", encode_labels("tags"))
        .select(*keys, "tokens", "tags", "labels")
    )


def split_sizes(n: Column) -> tuple[Column, Column]:
    """Held-out and test sizes: a fifth rounded up, then half of it rounded up."""
    held = F.ceil(F.lit(0.2) * n)
    return held, F.ceil(F.lit(0.5) * held)


def split_80_10_10(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds `split` with exact sizes: rows are ranked by a hash of key and seed.

    The global rank is the rank within one of 65536 hash ranges plus the rows
    in the ranges before it, so no task ever sorts the whole table; the list of
    ranges is the only thing that is broadcast.
    """
    ranked = df.withColumn(
        "_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|split|{seed}")))
    ).withColumn("_range", F.substring("_h", 1, 4))
    sizes = ranked.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    everything = W.partitionBy(F.lit(0))
    bases = sizes.select(
        "_range",
        (F.sum("_size").over(everything.orderBy("_range")) - F.col("_size")).alias("_base"),
        F.sum("_size").over(everything).alias("_total"),
    )
    held, test = split_sizes(F.col("_total"))
    rank = F.row_number().over(W.partitionBy("_range").orderBy("_h", key)) + F.col("_base")
    return (
        ranked.join(F.broadcast(bases), "_range")
        .withColumn("_rank", rank)
        .withColumn(
            "split",
            F.when(F.col("_rank") <= test, "test")
            .when(F.col("_rank") <= held, "validation")
            .otherwise("train"),
        )
        .drop("_h", "_range", "_base", "_total", "_rank")
    )
