"""A training corpus from documents: language ID, line dedup, near dedup, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import entry, langid, line_dedup, mixing, neardup, pieces
from brindle.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (null texts, texts without a letter) go."""
    return langid.keep_known(docs, entry.language_model(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in five documents or more stay in the last of them; n_chars is counted anew."""
    return line_dedup.with_lengths(line_dedup.dedup_lines_keep_columns(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return neardup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its shards."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its token ids."""
    return pieces.encode_columns(docs, pieces.read_model(entry.MODEL))


STAGES: list[tuple[str, Stage]] = [("language_id", language), ("line_dedup", lines), ("near_dedup", near), ("mixing", mix), ("sentencepiece", tokens)]

#: The stages sample by hash, estimate and encode, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
