"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Language identification, exact duplicates, near duplicates, mixing to target weights, packing. Every
stage takes all rows its predecessor left; the last returns pieces of sequences.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from sievemill.llm.exact_dedup import deduplicate
from sievemill.llm.language_id import keep_identified
from sievemill.llm.minhash import drop_near_duplicates
from sievemill.llm.mixing import mixed_documents
from sievemill.llm.packing import pack
from sievemill.llm.queries import vocabulary
from sievemill.llm.shared import read_table, stored_alone


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is unknown go. A row is judged by itself, whatever ids repeat or are null."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest id stays; a null id is the smallest, and of equal ids one row stays. A null text is an empty one."""
    return deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates and what they link, the one with the smallest id stays; a null id is the largest, and of equal ids one row stays. Rows without words stay."""
    return drop_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is there as often as the mix takes it: none, once or twice; rows of one id go by their own source, and those without words go."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences along the space-filling curve; a repeated document is packed each time."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: The language model, the similarity components and the packing order aren't expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored_alone(spark, partial(stage, spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
