"""The queries of this subpackage by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, contamination, language, minhash, pii, repeats, secrets, tokenfile, toxicity, vectors

QUERIES = {
    "op1_language_id": language.query,
    "op2_decontamination": contamination.query,
    "op3_toxicity": toxicity.query,
    "op4_bpe": bpe.query,
    "op5_pii": pii.query,
    "op6_embedding_dedup": vectors.query,
    "op7_substring_dedup": repeats.query,
    "op8_secrets": secrets.query,
    "op9_minhash_dedup": minhash.query,
    "op10_token_file": tokenfile.query,
}
ORACLES = {
    "op6_embedding_dedup": vectors.ORACLE_SQL,
    "op7_substring_dedup": repeats.ORACLE_SQL,
    "op9_minhash_dedup": minhash.ORACLE_SQL,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
