"""The operators applied to the given tables, one query for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import (
    embedding_dedup, exact_dedup, language_id, manifest, mixing, packing, pii, quality, resampling, simhash, suffix_dedup,
    token_counts, toxicity,
)

FOUND: dict = {}


def query(run):
    FOUND[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a tokenizer's file on this machine and, as the package is installed there too, on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op2_pii(spark, sf_dir):
    return pii.find_spans(table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark, sf_dir):
    return toxicity.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


@query
def op5_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op6_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query
def op7_language_id(spark, sf_dir):
    return language_id.identify_held_out(table(spark, sf_dir, "documents"))


@query
def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_mixing(spark, sf_dir):
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


@query
def op10_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents")).drop("language")


@query
def op11_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


@query
def op13_manifest(spark, sf_dir):
    """Proofs of all documents, some of which state one character more than they have."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claims = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return manifest.document_manifest(table(spark, sf_dir, "documents"), claims=claims)
