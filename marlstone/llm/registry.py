"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import ann, decontamination, language_model, packing, sharding, simhash, substring_dedup, toxicity, url_filter
from marlstone.llm.shared import reachable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learnt from labelled rows outside the held-out fold."""
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(documents, table(spark, sf_dir, "labels"))
    out = toxicity.score(documents, model, keep=["doc_id"])
    return out.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
        F.col("_spans").alias("spans"),
    )


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that overlap in at least 13 words (or the whole item), 80 % of them equal."""
    out = decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", F.explode("_leaks").alias("leak")).select("doc_id", "leak.*")


def op3_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes; equal texts share a shard."""
    out = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


URL_RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]


def op4_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against URL_RULES; urls that no rule fits are allowed."""
    out = url_filter.apply_rules(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = """
WITH parts AS (
  SELECT page_id,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) END AS path
  FROM pages),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/'
    END AS rule FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 ids; digests of the id and position rows, and what lies where."""
    out = packing.pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "sequence_id", "n_tokens", "cu_seqlens", "doc_ids", "doc_starts", F.crc32("ids").alias("ids_crc32"), F.crc32("position_ids").alias("position_ids_crc32")
    )


def op6_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 greatest inner products of every vector whose id is divisible by 20."""
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20)


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under a model of those outside the held-out fold."""
    documents = table(spark, sf_dir, "documents")
    held_out = language_model.in_fold(F.col("doc_id"), 7, 2)
    model = language_model.train(documents.where(~held_out))
    out = language_model.score(documents, model, keep=["doc_id"])
    return out.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("_n_tokens").alias("n_tokens"),
        F.col("_n_known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("_base_score").alias("base_score"),
        F.col("_score").alias("score"),
    )


def op8_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in full windows of 2048, 1024, 512 or 256 ids, the rest of each task in powers of two; one row per piece."""
    out = packing.pack_tiers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    return out.select(
        "doc_id",
        F.col("_start").alias("start"),
        F.col("_length").alias("length"),
        F.crc32("_ids").alias("ids_crc32"),
        F.col("_doc_tokens").alias("doc_tokens"),
        F.col("_sequence_id").alias("sequence_id"),
        F.col("_offset").alias("offset"),
        F.col("_tier").alias("tier"),
        F.col("_step").alias("step_group"),
    )


def op9_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit fingerprints of 4-word shingles, linked at 4 or fewer differing bits."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, lanes=1, radius=4, keep=["doc_id"])
    return out.select("doc_id", F.lower(F.hex("_print")).alias("fingerprint"), "component_id")


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of windows of 50 that start in an earlier document too are removed."""
    out = substring_dedup.without_repeats(table(spark, sf_dir, "documents"), window=50, keep=["doc_id"])
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept_sha256").alias("kept_sha256"))


OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_id, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.row_id, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.row_id <> c.row_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP10_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 49), ' ') AS k FROM starts),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
cut AS (SELECT win.doc_id, unnest(generate_series(i, i + 49)) AS p FROM win JOIN least ON win.k = least.k WHERE m < win.doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM cut GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id
"""

QUERIES = {
    "op1_crf_toxicity": op1_crf_toxicity,
    "op2_spaced_seeds": op2_spaced_seeds,
    "op3_minimax_sharding": op3_minimax_sharding,
    "op4_url_cascade": op4_url_cascade,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_one_bit_codes": op6_one_bit_codes,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_tiered_packing": op8_tiered_packing,
    "op9_simhash_tiles": op9_simhash_tiles,
    "op10_recompression": op10_recompression,
}

ORACLE_SQL = {
    "op4_url_cascade": OP4_SQL,
    "op6_one_bit_codes": OP6_SQL,
    "op10_recompression": OP10_SQL,
}
