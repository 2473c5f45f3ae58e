"""A training-data pipeline over the documents table; each stage works on all that the one before it kept.

Five-word shingles and a similarity of 0.8 make near copies; strings of 200 bytes that repeat are cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, common, jaccard, mixing, quality, suffixes
from factloom.session import ship


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    ship(spark)
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by id, of each group of near copies."""
    ship(spark)
    return jaccard.one_of_each(docs, n_words=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that repeat; texts with nothing left go."""
    ship(spark)
    return suffixes.cleaned(docs, 200)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mix."""
    ship(spark)
    return bpe.encode_documents(docs)


STAGES = [("quality", keep_good), ("near copies", drop_near_copies), ("repeats", cut_repeats), ("mix", mix_sources), ("tokens", encode)]

#: SQL can't express the language model, the repeats or the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
