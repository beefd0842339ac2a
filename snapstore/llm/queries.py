"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_partitions, best_fit, bpe_rank, jaccard_forest, line_crf, line_dedup, lm_trie, quality_rules, sharding, toxicity
from .common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "language")


ORACLE["op1_quality_rules"] = quality_rules.oracle_sql()


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bpe_rank.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return d.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE["op4_line_dedup"] = line_dedup.oracle_sql()


@query
def op7_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.shard(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(remainder(F.col("doc_id"), toxicity.HELD_OUT_MOD) == toxicity.HELD_OUT, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = line_crf.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(remainder(F.col("doc_id"), line_crf.HELD_OUT_MOD) == line_crf.HELD_OUT, F.lit(False))
    return line_crf.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op6_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_forest.classes(table(spark, sf_dir, "documents"))


@query
def op8_lm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    trie = lm_trie.build(docs.where(~held_out))
    d = lm_trie.score(docs, trie)
    return d.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(trie.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query
def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann_partitions.nearest(rows, rows.where("vec_id % 20 = 0"))
