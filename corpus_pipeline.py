"""A training corpus from the documents table, in five stages.

Each stage gets the documents that the one before it kept, as a stored table, and
returns the columns of documents; the last one returns their tokens. Rows are
followed by their number in the stage's input, so null and repeated ids are no
matter. Extra columns of the documents are passed through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanguard.llm.bpe import round_trip
from spanguard.llm.common import packed_text, read, stored, unpacked_text
from spanguard.llm.decontamination import contained_items
from spanguard.llm.exact_dedup import exact_groups
from spanguard.llm.language_id import UNKNOWN, language_column, remainder, train_language
from spanguard.llm.near_dedup import near_groups
from spanguard.llm.queries import vocabulary

NUMBER = "__row"


def numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn(NUMBER, F.monotonically_increasing_id())


def keep(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of `docs` (numbered) whose number is in `rows`.

    Texts are compressed on their way through the join.
    """
    packed = docs.withColumn("text", packed_text("text"))
    kept = packed.join(rows.select(F.col("row_no").alias(NUMBER)), NUMBER, "left_semi").drop(NUMBER)
    return kept.withColumn("text", unpacked_text("text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: texts that are null or have no letter are rejected.

    The model is learned from labelled documents as in the query of its own. It names
    the language of each text that has a letter; which one decides nothing here, so
    without labelled documents the same texts are rejected.
    """
    model = train_language(docs.filter(remainder("doc_id", 3) != 1))
    if model.net is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return docs.filter(language_column(model, F.col("text")) != UNKNOWN)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for A-Z in either case), the one with the largest doc_id."""
    docs = numbered(docs)
    return keep(docs, exact_groups(docs, row_col=NUMBER).filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8), the one with the smallest doc_id."""
    docs = numbered(docs)
    return keep(docs, near_groups(docs, row_col=NUMBER).filter("kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; with DataFrame functions only, texts in the join too."""
    docs = numbered(docs)
    found = contained_items(docs, read(spark, sf_dir, "benchmark"), row_col=NUMBER, short_items=True)
    return docs.join(found.select(F.col("row_no").alias(NUMBER)), NUMBER, "left_anti").drop(NUMBER)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number of tokens, and the digests of ids and decoded text."""
    return round_trip(docs, vocabulary())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", tokens),
]
#: SQL can't express the language model, the near-duplicate groups or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
