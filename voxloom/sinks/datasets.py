"""Writing clip tables as datasets, parquet or a manifest CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.columns import has_channels, has_samples
from voxloom.schemas import SAMPLE_COUNT
from voxloom.sources.clips import read_keyed

# Text survives a round trip with these: quotes, commas, line breaks, outer blanks,
# and null told apart from empty.
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "nullValue": "\\N",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def laid_out_by_subset(clips: DataFrame) -> bool:
    """Whether a table's files lie in one folder for each subset, so that a task reads few of them."""
    return any("/subset=" in name for name in clips.inputFiles()[:1])


def with_sample_count(clips: DataFrame) -> DataFrame:
    """Clips with decoded audio and how many samples a channel of it has; others as they are."""
    if "audio" not in clips.columns or SAMPLE_COUNT in clips.columns or not has_samples(clips.schema["audio"].dataType):
        return clips
    samples = F.col("audio.array")
    if has_channels(clips.schema["audio"].dataType):
        samples = F.get(samples, F.lit(0))  # channels are equally long
    return clips.withColumn(SAMPLE_COUNT, F.when(samples.isNotNull(), F.size(samples)).cast("bigint"))


def write_dataset(clips: DataFrame, path: str, *, gather: bool = True) -> None:
    """Write clips with one folder per subset.

    ``gather`` collects each subset into few files, and splits large ones: a language with
    a third of the clips is still written by many tasks. Without it every task writes a file
    for each subset it meets: that needs no shuffle, and suits clips that are scanned from a
    table laid out by subset.

    Decoded audio gets the number of its samples beside it, so that lengths can be had without reading it.
    """
    clips = with_sample_count(clips)
    rows = clips.hint("rebalance", "subset") if gather else clips
    rows.write.partitionBy("subset").parquet(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return read_keyed(spark, path)


def write_parquet(clips: DataFrame, path: str) -> None:
    """Write clips with audio embedded, as parquet parts of whatever size they come in."""
    clips.write.parquet(path)


def write_manifest_csv(clips: DataFrame, path: str) -> None:
    """Write every column but the audio as CSV with a header."""
    clips.drop("audio").write.options(quoteAll=True, **CSV_OPTIONS).csv(path)


def read_manifest_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(multiLine=True, **CSV_OPTIONS).csv(path)
