"""The corpus pipeline: toxicity, line dedup, near-duplicates, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from velar.llm import decontaminate, lines, packing, simhash, toxicity
from velar.llm.common import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on all labels, scores below one half.

    Rows without text stay. Repeated rows stay or go together. Very long texts are scored whole. Without documents or
    labels nothing goes. All columns stay, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.kept(docs, toxicity.train(docs, labels))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that repeat an earlier one or lie within two edits of it.

    Earlier is by doc_id, null first, then by line; rows of one doc_id count as one document. Null texts stay null, and
    a text may become empty. Very long texts and lines are read whole. All columns stay, whatever their names.
    """
    return lines.deduplicated(docs, most=2, counts=False)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group that pairs of similarity 0.8 on five-word shingles link.

    Texts without words are one group. Rows that repeat an id stay or go together, rows with a null id stay. Very long
    texts are compared whole. All columns stay.
    """
    return simhash.kept(docs, ngram=5, similarity=0.8)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words that belong to windows of ten benchmark words.

    Null texts stay null; a text may become empty; without a benchmark nothing goes. Repeated rows each stay. Very long
    texts are searched whole. All columns stay.
    """
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)


def in_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in batches of padded token sequences.

    Null and empty texts keep one row without a place. Repeated rows and null ids count each. Very long texts make as
    many pieces as they need. Only doc_id and text are read.
    """
    return packing.packed(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("near duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", in_batches),
]

#: A trained model, an edit join, MinHash candidates and a tokenizer are beyond SQL; tests hold run() to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
