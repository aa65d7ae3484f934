"""Clip tables and catalogs derived from the given tables, for queries, tests and the bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom import load_catalog, refresh_catalog, write_catalog
from voxloom.session import scratch_path


# Columns used here. With a declared schema opening a table needs no job of its own.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_returnflag string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def doc_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a source clip table: text, undecoded audio, a duration of 256 characters a second.

    Ids are those of a source that numbers its splits one by one: validation and test clips
    have the ids of training clips.
    """
    block = F.floor(F.col("doc_id") / 20) % 20
    own = F.col("doc_id") + F.when(block == 0, 40).when(block == 1, 20).otherwise(0)
    return table(spark, sf_dir, "documents").select(
        own.cast("string").alias("id"),
        F.struct(
            F.col("text").cast("binary").alias("bytes"),
            F.concat(F.lit("clips/"), F.col("doc_id").cast("string"), F.lit(".mp3")).alias("path"),
        ).alias("audio"),
        F.col("text").alias("transcript"),
        (F.col("n_chars").cast("double") / 256).alias("duration"),
        F.col("source"),
        F.concat_ws("_", "source", "lang").alias("subset"),
        F.when(block == 0, "validation").when(block == 1, "test").otherwise("train").alias("split"),
    )


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source", "lang").distinct().select(
        F.concat_ws("_", "source", "lang").alias("subset"),
        F.col("source").alias("language"),
        F.col("lang").alias("iso"),
        F.upper("lang").alias("country"),
    )


def doc_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh_catalog(doc_clips(spark, sf_dir), doc_labels(spark, sf_dir))


def item_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a source clip table without transcripts: one subset per supplier."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    clip_id = F.concat_ws("-", *[F.col(k).cast("string") for k in keys])
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        clip_id.alias("id"),
        F.struct(F.lit(None).cast("binary").alias("bytes"), F.concat(clip_id, F.lit(".mp3")).alias("path")).alias("audio"),
        F.col("l_quantity").alias("duration"),
        F.concat(F.lit("sup_"), F.col("l_suppkey").cast("string")).alias("subset"),
        F.when(flag == "N", "train").when(flag == "R", "dev").otherwise("test").alias("split"),
    )


def item_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as languages. A few nations go by the code of a known country."""
    codes = F.create_map(*[F.lit(v) for pair in NATION_CODES.items() for v in pair])
    joined = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return joined.select(
        F.concat(F.lit("sup_"), F.col("s_suppkey").cast("string")).alias("subset"),
        F.col("s_name").alias("language"),
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("iso"),
        F.coalesce(F.try_element_at(codes, F.col("n_name")), F.col("n_name")).alias("country"),
    )


NATION_CODES = {"NATION_0": "GH", "NATION_1": "NG", "NATION_2": "KE", "NATION_3": "CI", "NATION_4": "RE"}


def item_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh_catalog(item_clips(spark, sf_dir), item_labels(spark, sf_dir))


def stored_item_catalog(spark: SparkSession, sf_dir: str, prefix: str = "") -> DataFrame:
    """The item catalog written once and read back, as users keep theirs. ``prefix`` goes before language names."""
    path = scratch_path(spark, "catalog")
    catalog = item_catalog(spark, sf_dir)
    write_catalog(catalog.withColumn("language", F.concat(F.lit(prefix), "language")), path)
    return load_catalog(spark, path)


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as decoded audio. Label 0 gives a rate of 0, which cannot be measured."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        F.struct(
            F.col("embedding").alias("array"), (F.col("label") * 3).cast("int").alias("sampling_rate")
        ).alias("audio"),
        F.concat(F.lit("wave_"), F.col("label").cast("string")).alias("subset"),
        F.lit("train").alias("split"),
    )
