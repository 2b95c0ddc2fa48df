"""The corpus pipeline: five stages over `documents`, each working on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import language_id, mixing, segment_bpe, simhash, substring_dedup
from talus.llm.common import documents, stored


def _sized(docs: DataFrame) -> DataFrame:
    """Characters counted anew after texts changed, where the table counts them."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language is ambiguous, go.

    So do null and empty texts.  Repeated rows and null ids are judged by their texts; an empty
    table, or one without labels to learn from, leaves none.
    """
    return language_id.accepted(docs, language_id.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays: that of the least id.

    Null texts and texts without words are one group.  Of rows that share an id one stays; rows of
    null id stay, since no id stands for them; an empty table stays empty.
    """
    return simhash.one_of_each(docs)


def exact_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur more than once are cut out of the texts.

    All their occurrences go, in whole characters; documents stay, if only with an empty text.
    Null texts stay null; repeated rows and null ids are documents of their own; an empty table
    stays empty.
    """
    return _sized(substring_dedup.without_repeats(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, kept or dropped so that sources meet their target sizes.

    Null and empty texts have no words and stay once; null sources are one source; rows that share
    an id and a size are taken alike; an empty table stays empty.
    """
    return _sized(mixing.mixed(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text is encoded and decoded; counts and digests are returned, one row a row of the mix.

    Null text is empty; ids repeat as documents do, and a null id stays null; an empty table gives none.
    """
    return segment_bpe.bpe_digest(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", exact_substrings),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
