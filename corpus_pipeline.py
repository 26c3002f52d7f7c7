"""A corpus pipeline: toxic documents go, near copies go, repeated passages are cut, benchmark leaks go, the rest is packed.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written
and read again as the next one's ``docs``. All but the last return the columns of
``docs``. ``ORACLE_SQL`` is None: SQL expresses none of these stages; the tests
compare each with a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontamination, packing, simhash, substring_dedup, toxicity
from marlstone.llm.shared import reachable, settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; ties are toxic."""
    reachable(spark)
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model, threshold=0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose 5-word shingles are about 0.8 alike or more, the row with the smallest doc_id stays."""
    reachable(spark)
    return simhash.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that an earlier document holds are cut; ``n_chars`` follows the new text. No row goes."""
    reachable(spark)
    out = substring_dedup.deduplicate(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. Items of fewer than 8 words are no passages: ordinary text holds them by chance."""
    reachable(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_words=8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in the training sequences, with its ids."""
    reachable(spark)
    out = packing.pack_tiers(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    return out.select(
        "doc_id", F.col("_start").alias("start"), F.col("_length").alias("length"), F.col("_ids").alias("ids"), F.col("_doc_tokens").alias("doc_tokens"),
        F.col("_sequence_id").alias("sequence_id"), F.col("_offset").alias("offset"), F.col("_tier").alias("tier"), F.col("_step").alias("step_group"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
