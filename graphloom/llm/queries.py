"""The queries of this subpackage: one thin query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import ans, htmlcut, langid, linededup, mixing, packing, passages, permindex, simhash, tiff


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ans.round_trip(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without later copies of repeated line runs, n_chars, removed_lines."""
    return linededup.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars", "removed_lines")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcut.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(table(spark, sf_dir, "documents"))


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_duplicate_passages(table(spark, sf_dir, "documents"))


def op10_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permindex.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def queries() -> dict:
    return {f.__name__: f for f in (op1_pack_windows, op2_rans_ids, op3_language, op4_line_runs, op5_main_text, op6_mix_sources, op7_tiff_media, op8_simhash_groups, op9_passages, op10_permutation_search)}


def oracle_sql() -> dict[str, str]:
    return {"op6_mix_sources": mixing.oracle()}
