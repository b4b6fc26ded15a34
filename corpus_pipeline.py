"""A training corpus from raw documents: each stage calls one operator, and what it decides takes effect.

Each stage takes (spark, docs, sf_dir) and gives the rows that it keeps with the columns of documents; the
last gives each document's tokens. run() writes each stage's result to the shared folder and reads it
again for the next, so that a lost executor never sends the work back to the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import bpe, common, contamination, language, minhash, secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found, and lang says which; texts that are null, empty or without a letter go.

    Labels in lang teach the model; what it finds takes their place, for labelled and unlabelled documents alike. Repeated
    rows each stay or go, extra columns of any name stay, an empty table stays empty.
    """
    return language.keep_identified(docs, language.train(docs), lang="lang")


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near copies (five words, similarity of 0.8).

    Of rows with one doc_id and text, one stays; rows with a null doc_id and texts without words all stay.
    """
    return minhash.dedup(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null texts stay, repeated rows each stay or go."""
    return contamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark; null texts stay null, n_chars stays that of the raw document."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's columns but its text, and its token ids with their number and hashes; null texts have no ids."""
    return bpe.encode(docs).drop("text")


STAGES = [
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("encode", encode),
]

#: SQL can't express the language model, the edit distances, the Markov model or BPE; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with common.scratch() as stay:
            docs = common.cut(stage(spark, before, sf_dir), name)
            stay.append(docs)
        # what a stage and its operators wrote is read no more once the next stage's result stands
        common.release(before)
        before = docs
    return docs
