"""A training corpus from raw documents, in five stages over the operators of ``factloom.llm``.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns of ``documents``; the last returns the
pieces of the packed sequences. A stage works on all rows its predecessor kept. Nulls, empty texts, repeated rows, empty
tables and extra columns are handled as the operators' docstrings say; columns beyond those of ``documents`` are carried.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import chosen_path, crf_quality, hilbert_pack, pareto_mix, pfp_dedup, store

#: Arrow batches of the first two stages: executor and workers hold several of them, whose memory the JVM keeps.
BATCH = "2m"
#: No stage but the mix can be said in SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject."""
    store.small_batches(spark, BATCH)
    model = crf_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = crf_quality.score(docs, model, keep=tuple(docs.columns))
    return scored.where("score >= 0.3").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    store.small_batches(spark, BATCH)
    return chosen_path.deduplicate(docs, words=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 100 bytes that stand earlier in the corpus; cut characters stay whole."""
    store.small_batches(spark)
    out = pfp_dedup.remove_repeats(docs, 100, whole_characters=True)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept").cast("string"))
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mix takes them."""
    return pareto_mix.repeat_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return hilbert_pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("mixture", mixture), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
