"""The training-corpus pipeline: five stages over documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next stage's docs. All but the last keep the columns of
documents; the last adds size, text_crc32, shard and slot.

A stage deletes the scratch tables that its result does not read; run() deletes
the rest, and the stage's input, once the next stage's input is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontaminate, language, mixing, sharding, shingles, store


@store.tidy
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; rejected ones go."""
    return language.identify(docs, language.fit(docs), accepted_only=True)


@store.tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return shingles.one_of_each(docs)


@store.tidy
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark contamination."""
    return decontaminate.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean_only=True)


@store.tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


@store.tidy
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in shards cut from the Hilbert curve."""
    return sharding.shard(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: the language models, components and fair queues have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, f) in enumerate(STAGES):
        with store.span() as made:
            docs = f(spark, docs, sf_dir)
            if i + 1 < len(STAGES):
                docs = store.stored(docs, f"stage_{i}")
                store.released(spark, made, used_by=docs)
                store.released(spark, before)
        before = made
    return docs
