"""The named queries of the operators: each applied to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edupulse.llm import decontamination, extraction, hard_negatives, packing, prefix_trie, quality_rules, sharding, simhash, substrings, surrogates, token_store, toxicity, url_filters
from edupulse.llm.oracles import ORACLES  # noqa: F401
from edupulse.llm.staging import ship_library, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_library(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        return function

    return add


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


@query("op4_token_store")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.temporary_store(spark)
    token_store.write_store(table(spark, sf_dir, "documents"), path)
    return token_store.checksums(token_store.read_store(spark, path))


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


@query("op6_pii_surrogates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.report(table(spark, sf_dir, "documents"))


@query("op7_html_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_prefix_trie")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(table(spark, sf_dir, "conversations"))


@query("op12_url_filters")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.report(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op13_hard_negatives")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))
