"""Training-data pipeline over ``documents``: each stage's result is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import langid, linededup, mixing, packing, simhash
from graphloom.llm.shared import give_back, staged
from graphloom.llm.tokens import SMALL_TABLE_BYTES


def relieved(run):
    """A stage that begins with executors whose heaps hold nothing that the stage before has left."""

    @functools.wraps(run)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return run(spark, docs, sf_dir)

    return stage


@relieved
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter, or in no learned language, go."""
    return langid.identified(docs)


@relieved
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut out; documents of which nothing is left go."""
    return linededup.deduplicated_rows(docs)


@relieved
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a near copy (five-word shingles, Jaccard 0.8 or more) with a smaller id stays go."""
    return simhash.one_of_each(docs)


@relieved
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the sources' target weights; some are taken twice."""
    return mixing.mixed_documents(docs)


@relieved
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows in the mix's proportions."""
    found = packing.pack(docs, table_bytes=SMALL_TABLE_BYTES)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: Language, line runs and components can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
