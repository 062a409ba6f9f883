"""From raw documents to token ids: language, near-duplicates, benchmark leaks, source mix, packed tokens.

Each stage takes all that the one before kept, written as Parquet and read again; all but the last return the columns of documents.

Nulls and edge cases: a null text, or one without a letter, goes at the first stage (no language is recognised); null languages, sources and
ids stay. Very long texts are read whole. Rows alike in id and text are one document from the second stage on; rows that share an id only
stay apart. An empty table gives an empty result; other columns go through the first four stages unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from titlelink.llm import decontaminate, language_id, mixing, near_dup, token_pack
from titlelink.llm.common import materialise, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from a bounded sample of the documents with a language. Without any, only
    texts without a letter go."""
    return language_id.accepted(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's target takes them."""
    return mixing.remake(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in packed blocks, and what the files say of each document."""
    return token_pack.encode_and_read(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_dup", near_duplicates),
    ("decontaminate", decontamination),
    ("mixing", mix),
    ("token_pack", tokens),
]
#: Language models, signatures and tokenizers are beyond SQL: the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
