"""A training-data pipeline over ``documents``: five operators in a row, each on all that the one before kept.

All stages take nulls in any column, repeated rows, empty tables and columns of any further name; an empty table gives
no rows. All but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyveil.llm import language
from tallyveil.llm.components import saved
from tallyveil.llm.decontamination import decontaminated
from tallyveil.llm.jaccard import near_duplicates
from tallyveil.llm.packing import pack, token_pieces
from tallyveil.llm.substring_dedup import without_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the model learns from a bounded sample of their own labels.

    Texts that are null, empty or without a letter are rejected, as are those scored below the threshold. Without any
    label no text with a letter is rejected. Repeated rows are judged alike; long texts are read whole.
    """
    return language.accepted(docs, language.fit(docs))


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): that of the smallest id.

    Wordless and null texts have no copies and stay. Rows without an id stay. Rows that share an id stay or go
    together, but of rows equal in id and text one stays.
    """
    return near_duplicates(docs)


def substring_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 13-word windows that a document of smaller id holds; emptied ones go.

    Texts without such a window stay as they are, null and empty ones included; others have single spaces and a new
    ``n_chars``. A null id counts as the largest; rows of one id do not take from each other.
    """
    return without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, verbatim or with other numbers, names and units.

    Null and empty texts match nothing. Rows of one id go together; rows without an id stay. An empty benchmark removes
    nothing; its null and empty items match nothing.
    """
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences of at most 4096 tokens.

    Null and empty texts are the closing id alone. Longer documents are cut; every row is packed, repeated ones and
    those without an id too.
    """
    return pack(token_pieces(docs))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicate_removal),
    ("substring_dedup", substring_deduplication),
    ("decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: SQL cannot express the model or the tokenizer; tests/llm/test_registered.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
