"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plantscope.llm import bpe_tree, collocations, factor_dedup, impact_index, line_spread, packing, prefix_trie, radix_dedup, reply_trees, secrets, shards, simhash, toxicity
from plantscope.plans.registry import Query, read


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(read(spark, sf_dir, "documents"))


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.digest(read(spark, sf_dir, "documents"))


def op4_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(read(spark, sf_dir, "documents"))


def op5_impact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.digest(read(spark, sf_dir, "embeddings"))


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.digest(read(spark, sf_dir, "documents"))


def op7_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_trees.digest(read(spark, sf_dir, "conversations"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_dedup.equal_texts(read(spark, sf_dir, "documents"))


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.digest(read(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.digest(read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.digest(read(spark, sf_dir, "conversations"))


def op13_factor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor_dedup.digest(read(spark, sf_dir, "documents"))


QUERIES = (
    Query("op1_secret_scan", op1_secret_scan, secrets.DIGEST_SQL),
    Query("op2_simhash_dedup", op2_simhash_dedup),
    Query("op3_histogram_shards", op3_histogram_shards),
    Query("op4_nnls_packing", op4_nnls_packing),
    Query("op5_impact_top_k", op5_impact_top_k, impact_index.DIGEST_SQL),
    Query("op6_bpe_tree", op6_bpe_tree),
    Query("op7_reply_trees", op7_reply_trees, reply_trees.DIGEST_SQL),
    Query("op8_toxicity", op8_toxicity),
    Query("op9_radix_dedup", op9_radix_dedup, radix_dedup.DIGEST_SQL),
    Query("op10_line_spread", op10_line_spread, line_spread.DIGEST_SQL),
    Query("op11_collocations", op11_collocations, collocations.DIGEST_SQL),
    Query("op12_prefix_trie", op12_prefix_trie, prefix_trie.DIGEST_SQL),
    Query("op13_factor_dedup", op13_factor_dedup),
)
