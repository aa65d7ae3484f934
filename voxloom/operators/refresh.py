"""Rebuilding the catalog from the clips themselves."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.columns import TICKS, has_channels, has_samples, hours, split_name, ticks, waveform_seconds
from voxloom.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS
from voxloom.schemas import CATALOG_COLUMNS, SAMPLE_COUNT
from voxloom.sources.clips import duration_column, read_keyed

# What one file adds to the catalog: its identity, then a row for each subset and split in it.
FILE_COLUMNS = ["file", "size", "changed"]
LEDGER_SCHEMA = f"file string, size bigint, changed timestamp, subset string, split string, clips bigint, ticks {TICKS}"


def _clip_seconds(clips: DataFrame, use_samples: bool):
    """Length of a raw clip: of its decoded samples where there are any, else as recorded."""
    recorded = duration_column(clips.columns)
    options = []
    if use_samples and "audio" in clips.columns and has_samples(clips.schema["audio"].dataType):
        rate = F.nullif(F.col("audio.sampling_rate"), F.lit(0)).cast("double")
        if SAMPLE_COUNT in clips.columns:  # counted when the clips were written, so no sample is read
            options.append(F.try_divide(F.col(SAMPLE_COUNT).cast("double"), rate))
        else:
            samples = F.col("audio.array")
            if has_channels(clips.schema["audio"].dataType):
                samples = F.get(samples, F.lit(0))  # channels are equally long
            options.append(F.when(samples.isNotNull(), waveform_seconds(samples, F.col("audio.sampling_rate"))))
    if recorded:
        options.append(F.col(recorded).cast("double"))
    return F.coalesce(*options, F.lit(0.0))


def refresh_catalog(
    clips: DataFrame,
    labels: DataFrame | None = None,
    listed: DataFrame | None = None,
    *,
    use_samples: bool = True,
) -> DataFrame:
    """One catalog row per subset: clips, hours and clips per split.

    ``labels`` (subset, language, iso, country) gives names to subsets; one without any
    goes by its subset name. Subsets of ``listed`` get a row even without clips.
    ``use_samples=False`` trusts recorded durations and so never reads audio.

    Clips are added up before anything is joined, with partial sums on the map side.
    """
    split = split_name(F.col("split"))
    lengths = ticks(_clip_seconds(clips, use_samples))
    return _catalog(clips.select("subset", split.alias("split"), F.lit(1).alias("clips"), lengths.alias("ticks")), labels, listed)


def _catalog(parts: DataFrame, labels: DataFrame | None, listed: DataFrame | None) -> DataFrame:
    """The catalog of clips that are told by (subset, split, clips, ticks), one by one or already added up."""
    of_split = lambda name: F.sum(F.when(F.col("split") == name, F.col("clips")))
    counted = parts.groupBy("subset").agg(
        F.sum("clips").alias("clips"), F.sum("ticks").alias("_ticks"),
        *[of_split(name).alias(name) for name in ("train", "val", "test")],
    )
    if listed is not None:
        counted = listed.select("subset").distinct().join(counted, "subset", "left")
    if labels is not None:
        known = labels.select("subset", "language", "iso", "country")
        counted = counted.join(known, "subset", "left")
    else:
        nothing = F.lit(None).cast("string")
        counted = counted.withColumns({"language": nothing, "iso": nothing, "country": nothing})
    number = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    return counted.select(
        "subset",
        F.coalesce("language", "subset").alias("language"),
        F.coalesce("iso", F.lit("")).alias("iso"),
        F.coalesce("country", F.lit("")).alias("country"),
        number("clips"),
        F.coalesce(hours(F.col("_ticks")), F.lit(0.0)).alias("hours"),
        number("train"), number("val"), number("test"),
    ).select(*CATALOG_COLUMNS)


def _present_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, changed) of the clip files below a folder. They are listed, not opened."""
    found = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.parquet").load(path)
    return found.select(
        F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed")
    )


def _ledger(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The ledger as of the last refresh and the number of that refresh; empty and 0 where there is none."""
    try:
        last = spark.read.text(f"{path}/last").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    if last is None:
        return spark.createDataFrame([], LEDGER_SCHEMA), 0
    number = int(last[0])
    return spark.read.schema(LEDGER_SCHEMA).parquet(f"{path}/turn={number % 2}"), number


def _added_up(clips: DataFrame, use_samples: bool) -> DataFrame:
    """(file, subset, split, clips, ticks) of clips that come straight from files."""
    return clips.select(
        F.col("_metadata.file_path").alias("file"), "subset", split_name(F.col("split")).alias("split"),
        ticks(_clip_seconds(clips, use_samples)).alias("_ticks"),
    ).groupBy("file", "subset", "split").agg(F.count("*").alias("clips"), F.sum("_ticks").cast(TICKS).alias("ticks"))


def refresh_files(
    spark: SparkSession,
    path: str,
    ledger: str,
    labels: DataFrame | None = None,
    listed: DataFrame | None = None,
    *,
    use_samples: bool = True,
) -> DataFrame:
    """``refresh_catalog`` of a folder of clip files that reads only those that are new or changed.

    ``ledger`` is a folder that keeps what each file adds: a row for each subset and split in it. Files are
    known by path, size and time of change. A removed or changed file loses its rows, so the
    catalog always is that of the files present. A refresh writes the ledger of the other turn and then
    its number; one that fails is simply done again. ``use_samples`` must stay as it was at first.

    Unchanged files are matched in Spark. Names of changed ones come to the driver only up to
    BROADCAST_ROWS and BROADCAST_BYTES; with more, as at the first refresh of a large table, the whole table is read.
    """
    known, number = _ledger(spark, ledger)
    present = _present_files(spark, path)
    changed = present.join(known, FILE_COLUMNS, "left_anti")
    files, size = changed.agg(F.count("*"), F.coalesce(F.sum(F.length("file")), F.lit(0))).first()
    if files == 0 and number:
        parts = known.join(present, FILE_COLUMNS, "left_semi")
    else:
        clips = read_keyed(spark, path)
        if files <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
            names = [unquote(row.file) for row in changed.select("file").collect()]
            clips = spark.read.schema(clips.schema).option("basePath", path).parquet(*names)
        # A file without clips has a row too, so that it is not read again.
        added = changed.join(_added_up(clips, use_samples), "file", "left")
        parts = known.join(present, FILE_COLUMNS, "left_semi").unionByName(added.select(*known.columns))
    turn = f"{ledger}/turn={(number + 1) % 2}"
    parts.write.mode("overwrite").parquet(turn)
    spark.createDataFrame([(str(number + 1),)], "value string").coalesce(1).write.mode("overwrite").text(f"{ledger}/last")
    kept = spark.read.schema(LEDGER_SCHEMA).parquet(turn)
    return _catalog(kept.where(F.col("clips").isNotNull()).select("subset", "split", "clips", "ticks"), labels, listed)
