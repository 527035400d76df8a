"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, source mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing
from sievework.llm.common import materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: null, empty and letterless texts.

    Defined cases as in language_id: without any labelled row all go; repeated rows are each kept; null ids stay; an empty
    table gives no rows; all columns are kept, whatever their names.
    """
    return language_id.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that align with an earlier document go, and documents that lose all.

    Defined cases as in line_dedup: null and empty texts stay; of equal texts the smallest id stays, rows equal in id and
    text fare alike; null ids come last; n_chars is that of the kept text; an empty table gives no rows.
    """
    return line_dedup.keep_remaining(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id.

    Defined cases as in jaccard_join: null, empty and wordless texts link with nothing and stay; rows that share id and
    text count once; rows without an id stay; an empty table gives no rows; all columns are kept, whatever their names.
    """
    return jaccard_join.keep_one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Defined cases as in decontaminate: null and empty texts stay, and all rows where the benchmark is empty; repeated rows
    fare alike; null ids are kept; an empty table gives no rows; all columns are kept, whatever their names.
    """
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the shards draw: a row for each draw of a document, in the order of shard and place, with size, source_size,
    target, taken and copies of its document.

    Defined cases as in mixing: null sources are a source; documents without words are taken with their blocks; equal rows
    fare alike; an empty table gives no rows; a column that has the name of a new one gets `_in` behind it.
    """
    return mixing.mixed_rows(mixing.mix(docs))


#: Each stage's result is written as Parquet and read again as the next one's docs.
STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontaminate", benchmark),
    ("mix_sources", mixture),
]

#: Language models, alignments and hypergeometric draws are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
