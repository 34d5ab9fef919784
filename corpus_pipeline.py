"""Corpus pipeline: toxicity, line dedup, near-duplicates, benchmark decontamination, tokens.

STAGES holds (name, function) pairs; each function takes (spark, docs, sf_dir) and returns
the documents it keeps, with the columns of `documents`; the last one returns token ids.
Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchwright.llm import bpe
from batchwright.llm.common import DOCUMENT_COLUMNS
from batchwright.llm.decontamination import decontaminate
from batchwright.llm.line_dedup import dedup_lines
from batchwright.llm.minhash_dedup import drop_near_duplicates
from batchwright.llm.toxicity import drop_toxic
from batchwright.storage import materialize

#: Vocabulary of the last stage.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: Percent of five-word shingles that near-duplicates share at least.
SIMILARITY = 80

#: The stages fit models and encode by a tokenizer's rules, which SQL cannot express.
ORACLE_SQL = None


def documents(docs: DataFrame) -> DataFrame:
    """The columns of the documents table, n_chars as the text now is; null texts have no characters to count."""
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    counted = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(n_chars)
    return docs.withColumn("n_chars", counted).select(*DOCUMENT_COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go; the labels it is fitted on are those of the documents given."""
    return documents(drop_toxic(docs.select(*DOCUMENT_COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; every document stays."""
    return documents(dedup_lines(docs.select(*DOCUMENT_COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return documents(drop_near_duplicates(docs.select(*DOCUMENT_COLUMNS), SIMILARITY))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go; documents that are mostly such passages go whole."""
    return documents(decontaminate(docs.select(*DOCUMENT_COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids of each document.

    The ids are decoded again where they are made; bytes that differ from the text stop the job.
    """
    path = public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode_documents(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, verify=True)
    return encoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
