"""Clip tables: parquet, usually partitioned by subset and split."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions.columns import check_split
from voxloom.schemas import DURATION_NAMES, SPLIT_ALIASES, TEXT_NAMES


def _first_present(columns: Sequence[str], accepted: Sequence[str]) -> str | None:
    spelling = {column.lower(): column for column in columns}
    return next((spelling[name] for name in accepted if name in spelling), None)


def text_column(columns: Sequence[str]) -> str | None:
    """The transcript column of a source, in its own spelling."""
    return _first_present(columns, TEXT_NAMES)


def duration_column(columns: Sequence[str]) -> str | None:
    """The column that already holds clip lengths in seconds, if there is one."""
    return _first_present(columns, DURATION_NAMES)


def in_split(clips: DataFrame, split: str) -> DataFrame:
    """Rows of one split, or of the three known ones. Compares stored values, so it prunes partitions."""
    check_split(split)
    wanted = SPLIT_ALIASES.values() if split == "all" else [SPLIT_ALIASES[split]]
    return clips.where(F.col("split").isin([name for names in wanted for name in names]))


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table whose partition folders hold text keys.

    Folder names like ``subset=007`` are taken for numbers at first; only then is the
    table opened again, with its keys declared as text.
    """
    stored = spark.read.parquet(path)
    declared = [T.StructField(f.name, T.StringType()) if f.name in ("subset", "split") else f for f in stored.schema]
    if declared == list(stored.schema):
        return stored
    return spark.read.schema(T.StructType(declared)).parquet(path)


def read_clips(
    spark: SparkSession, path: str, *, subsets: Iterable[str] | None = None, split: str = "all"
) -> DataFrame:
    """Clips of some subsets (all without a list) and one split or all of them."""
    clips = in_split(read_keyed(spark, path), split)
    if subsets is not None:
        clips = clips.where(F.col("subset").isin(list(subsets)))
    return clips
