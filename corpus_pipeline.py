"""From raw documents to token files: five stages, each over all that the one before kept.

Rows are told apart as rows: those that share an id, or have none, are judged each by itself. Other columns pass, whatever they
are called. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallygrove.llm import decontaminate, jaccard, mixing, quality, token_store
from tallygrove.llm.common import save


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; a text without a word has the share of good labels as its score."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id; texts without a word are in no group and stay."""
    return jaccard.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go; a null or empty text holds none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut at, or repeated up to, their budgets; texts without a word are taken 0 times, a null source is one too."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: a row a document, also for repeats; a null or empty text is the end id alone."""
    return token_store.store(docs)


STAGES = [
    ("quality classifier", judge_quality),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources", mix_sources),
    ("token output", write_tokens),
]
#: SQL has no learnt classifier and no tokenizer; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, f"stage-{k}")
    return docs
