"""From raw documents to a training mix: five stages, each over all that its predecessor kept.

1. quality_rules: documents that the base rules or the adaptive thresholds reject go.
2. near_dedup: of each component of near-duplicates, the least doc_id stays.
3. decontamination: documents with eight or more words in benchmark windows go; one passage is enough.
4. pii: personal data is replaced in the texts; n_chars follows.
5. mixing: the mix of sources, as rows (doc_id, source, pass, n_tokens, weight, block, slot).

Each stage but the last returns the columns of ``documents``.  Between stages the documents
are written as Parquet in the shared folder and read again, so a lost executor costs one
stage's tasks.  Nulls, empty texts, repeated rows and empty tables are treated as each
operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomry.llm import decontamination, mixing, near_dedup, pii, quality_rules
from fathomry.llm.common import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("quality_rules", quality), ("near_dedup", dedup), ("decontamination", decontaminate), ("pii", redact), ("mixing", mix)]

#: SQL can't express the search for personal data with its replacement, so a test holds the
#: pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch(docs, f"pipeline-{name}")
    return docs
