"""Training-data pipeline over `documents`: each stage reads the table that the one before it wrote.

Run on a cluster, the tables between stages lie in the shared folder that spark.checkpoint.dir names. In every stage an
empty table stays empty, all columns but those named stay as they are, very long texts are judged whole, and rows that
repeat id and text share their fate; a null id is told apart by the text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from corpusloom.session import Scratch, cut


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is identified; null, empty and letterless texts go. Of languages that tie, the one declared more often wins."""
    return language_id.keep_identified(docs, declared=F.col("lang"), host=F.col("source"), domain=F.lit(""))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines out that match an earlier line; documents of which no word is left by that go.

    Null texts and texts without a word stay. Of equal lines the first by doc_id and place stays. n_chars is renewed.
    """
    return line_dedup.dedup_lines(docs, least=1).withColumn("n_chars", F.length("text").cast("long"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, the one of least doc_id; null and empty texts stay, of a repeated row one."""
    return jaccard_join.drop_near_duplicates(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark passage, half of its words at least; null and empty texts stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences; a null or empty text is the one end token."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("language_id", identify),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", dedup_documents),
    ("benchmark_decontamination", clean_of_benchmark),
    ("packing", pack),
]
#: Tokenising and packing have no SQL form. Each stage is tested against a plain Python version (tests/llm/test_brute.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each table goes when the next one is written, and all of them on an error."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for i, (_, stage) in enumerate(STAGES):
            made, before = stage(spark, docs, sf_dir), docs
            if i + 1 == len(STAGES):
                return cut(made)
            docs = scratch.staged(made)
            if i:
                scratch.drop(before)
