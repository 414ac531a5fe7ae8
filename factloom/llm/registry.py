"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chosen_path, crf_quality, elias_fano, fim_frames, flat_graph, hilbert_pack, line_runs, media_tar, pareto_mix, pfp_dedup, phrases, prefix_targets, sql, store, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return store.small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_media_tar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_tar.media_table(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length", "width", "height", "bit_depth")


def op3_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_graph.near_links(_table(spark, sf_dir, "embeddings"))


def op4_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    saying = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(saying).alias("text"))
    return prefix_targets.read_back(prefix_targets.prefix_targets(turns.unionByName(extra)))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfp_dedup.kept_digests(_table(spark, sf_dir, "documents"), 100)


def op7_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_pack.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_elias_fano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elias_fano.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chosen_path.near_components(_table(spark, sf_dir, "documents"), words=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_fim_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_frames.fim_digests(_table(spark, sf_dir, "documents"))


def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.kept_digests(_table(spark, sf_dir, "documents"))


def op13_son_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_crf_quality, op2_media_tar, op3_flat_graph, op4_prefix_targets, op5_token_counts, op6_prefix_free_parsing, op7_hilbert_pack, op8_elias_fano_ids, op9_chosen_path, op10_pareto_mix, op11_fim_frames, op12_line_runs, op13_son_phrases)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
