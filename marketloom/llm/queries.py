"""Registered queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from marketloom.llm import bilinear_lm, chunk_bpe, conversation_repair, factor_quality, fim_assembly, hilbert_shards, near_dup, packing, rank_fold, rp_forest, secret_scan, segment_topk, url_lists


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_shards(spark, sf_dir):
    return hilbert_shards.shard(_table(spark, sf_dir, "documents"))


def op2_bilinear_lm(spark, sf_dir):
    return bilinear_lm.score(_table(spark, sf_dir, "documents"))


def op3_segment_topk(spark, sf_dir):
    return segment_topk.top_k(_table(spark, sf_dir, "embeddings"))


def op4_factor_quality(spark, sf_dir):
    return factor_quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_rp_forest(spark, sf_dir):
    return rp_forest.nearest(_table(spark, sf_dir, "embeddings"))


def op6_best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents")).drop("ids")


def op7_chunked_bpe(spark, sf_dir):
    return chunk_bpe.round_trip(_table(spark, sf_dir, "documents"))


def op8_guess_cost_secrets(spark, sf_dir):
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op9_temporal_url_lists(spark, sf_dir):
    return url_lists.query(_table(spark, sf_dir, "pages"))


def op10_simhash_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_fim_assembly(spark, sf_dir):
    return fim_assembly.round_trip(_table(spark, sf_dir, "documents"))


def op12_rank_fold_bpe(spark, sf_dir):
    return rank_fold.round_trip(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark, sf_dir):
    return conversation_repair.repair(conversation_repair.damage(_table(spark, sf_dir, "conversations")))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_hilbert_shards, op2_bilinear_lm, op3_segment_topk, op4_factor_quality, op5_rp_forest, op6_best_fit_packing, op7_chunked_bpe, op8_guess_cost_secrets, op9_temporal_url_lists, op10_simhash_near_dup, op11_fim_assembly, op12_rank_fold_bpe, op13_conversation_repair, pipeline)}


def oracle_sql() -> dict[str, str]:
    found = {"op9_temporal_url_lists": url_lists.ORACLE}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
