"""A corpus pipeline of five stages, from raw documents to token ids and their decoded text.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame; :func:`run` writes each stage's rows as Parquet
and reads them again for the next. Stages but the last return the columns of
``documents``. Rows with null texts or ids, repeated rows and empty tables go
through every stage; what each operator does with them is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folia.llm import bpe, decontaminate, langid, secrets, simhash
from folia.llm.common import written
from folia.llm.queries import vocabulary

ORACLE_SQL = None  # code lengths, fingerprints, entropies and merges are not for SQL; tests compare with brute force


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that can be told from its code length; ``lang`` stays as it was."""
    return langid.in_a_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the smallest id."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold too much of the benchmark."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; no document goes."""
    return secrets.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, and what these decode to."""
    return bpe.bpe_encode(docs, vocabulary("word_bpe_49k.json"), keep=["doc_id", "lang", "source"]).select("doc_id", "lang", "source", "ids", "decoded")


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe_encode", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
