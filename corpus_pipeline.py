"""Documents made ready for training: filtered, deduplicated, decontaminated, pseudonymised and packed.

Every stage is a function of (spark, docs, sf_dir) over all that its predecessor kept. All but the
last return the columns of documents. Odd cases are those of the operator that a stage calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edupulse.llm import decontamination, packing, quality_rules, simhash, surrogates
from edupulse.llm.staging import quoted, ship_library, stage, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    ship_library(spark)
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the least doc_id stays."""
    ship_library(spark)
    return simhash.near_dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    ship_library(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def hide_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text becomes surrogates; n_chars follows the text."""
    ship_library(spark)
    done = surrogates.pseudonymize(docs)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars"))
        done = done.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return done.select(*quoted(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    ship_library(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("pii_surrogates", hide_persons),
    ("best_fit_packing", pack),
]

# Fingerprints need XXH64 and the pieces a tokenizer, which SQL has not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
