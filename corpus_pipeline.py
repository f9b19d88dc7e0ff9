"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token-id files.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on: all but the
last return the columns of ``docs``, whatever these are.  A document that a stage rejects
is gone for the later ones.  Nulls, empty texts, repeated rows and empty tables have the
results that the operators' docstrings define.
"""

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontaminate, minhash, mixing, quality, tokenids
from loomgraph.llm._store import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or exceed a risk-controlled cutoff go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest doc_id, stays."""
    return minhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay with their cell's calibrated probability."""
    return mixing.sampled(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token-id files, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    return tokenids.token_id_corpus(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]

#: no single SQL text covers sampling by raked weights after near-dedup and alignment; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage-{number}")
    return docs
