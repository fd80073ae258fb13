"""A corpus from raw documents to packed sequences, in five stages.

Each stage gets the rows that its predecessor kept and returns rows with the
columns of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm.common import materialise
from loomspark.llm.jaccard import drop_near_copies
from loomspark.llm.mixing import sample_mixture
from loomspark.llm.packing import pack
from loomspark.llm.pii import redact_pii
from loomspark.llm.quality import filter_quality
from loomspark.llm.registry import MIXTURE, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is below a half, or that fail the base rules, go."""
    return filter_quality(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets at Jaccard 0.8 stays."""
    return drop_near_copies(docs, n=5, percent=80)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts; all documents stay."""
    return redact_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by the probabilities of the raked mixture."""
    return sample_mixture(docs, MIXTURE)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens, with their ids."""
    return pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard", ngram_jaccard), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: Not expressible in SQL (fitted models, a tokenizer); tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage kept is written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
